from corpaudit.functions.paths import *  # noqa: F401,F403
from corpaudit.functions.text import *  # noqa: F401,F403
from corpaudit.functions.values import *  # noqa: F401,F403
