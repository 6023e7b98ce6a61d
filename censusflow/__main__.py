import sys

from censusflow.plans.cli import main

sys.exit(main())
