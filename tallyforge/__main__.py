import sys

from tallyforge.cli import main

sys.exit(main())
