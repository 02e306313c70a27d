import sys

from marlstone.cli import main

sys.exit(main())
