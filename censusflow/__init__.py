"""censusflow: client-activity analytics as DataFrame plans."""
