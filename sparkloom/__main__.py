"""python -m sparkloom NAME FOLDER: shows a registered query over a folder of tables; without a name, lists them."""

import sys

from .plans.registry import QUERIES
from .session import local_session

if len(sys.argv) < 3:
    print(*sorted(QUERIES), sep="\n")
else:
    QUERIES[sys.argv[1]](local_session(), sys.argv[2]).show(50, truncate=80)
