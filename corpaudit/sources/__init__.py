from corpaudit.sources.packed import *  # noqa: F401,F403
from corpaudit.sources.repo_dirs import *  # noqa: F401,F403
