"""spark-submit entry of the dashboard refresh job; see clickfold/plans/refresh.py."""

import sys

from clickfold.plans.refresh import main

sys.exit(main(sys.argv))
