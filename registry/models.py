"""Every warehouse model and every consumer query."""

from undertow.plans import CONSUMERS, MODELS

from .core import query
from .model_sql import CONSUMER_SQL

for _name in MODELS:
    _key = _name if _name.startswith("o_") else f"m_{_name}"
    query(_key, f"from {{{_name}}}")(lambda w, n=_name: w[n])

for _name, _c in CONSUMERS.items():
    query(f"q_{_name}", CONSUMER_SQL[_name])(lambda w, c=_c: c.run(*[w[t] for t in c.reads]))
