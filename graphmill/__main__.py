import sys

from graphmill.cli import main

sys.exit(main())
