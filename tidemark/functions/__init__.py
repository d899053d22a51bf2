from tidemark.functions.scalars import *  # noqa: F401,F403
