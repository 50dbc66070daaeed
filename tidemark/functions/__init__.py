from tidemark.functions.calendar import *  # noqa: F401,F403
from tidemark.functions.scalars import *  # noqa: F401,F403
