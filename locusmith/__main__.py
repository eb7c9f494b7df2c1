import sys

from locusmith.plans.ingest import main

sys.exit(main(sys.argv[1:]))
