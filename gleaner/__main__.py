"""python -m gleaner"""

from .cli import main

main()
