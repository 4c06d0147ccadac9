"""Script for spark-submit; see ``clinimart/__main__.py`` for the jobs."""

from clinimart.__main__ import main

if __name__ == "__main__":
    main()
