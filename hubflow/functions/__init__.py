from hubflow.functions.cleaning import *  # noqa: F401,F403
from hubflow.functions.features import *  # noqa: F401,F403
