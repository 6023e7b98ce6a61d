"""DataFrame to DataFrame operators over the export relation."""
