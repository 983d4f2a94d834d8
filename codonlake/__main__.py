import sys

from codonlake.plans.pipeline import main

sys.exit(main())
