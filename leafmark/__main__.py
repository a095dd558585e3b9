"""python -m leafmark."""

import sys

from leafmark.cli import main

sys.exit(main())
