import sys

from stratalake.plans.cli import main

sys.exit(main())
