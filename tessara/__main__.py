import sys

from .plans import cli
from .retrieval import cli as retrieval_cli
from .streaming import cli as kv_cli

first = sys.argv[1] if len(sys.argv) > 1 else ""
if first in retrieval_cli.COMMANDS:
    sys.exit(retrieval_cli.main(sys.argv[1:]))
sys.exit(kv_cli.main(sys.argv[2:]) if first == "kv" else cli.main())
