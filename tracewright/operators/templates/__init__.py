"""Event ids from log templates.

Parsers are callables (df, column, ...) -> df with an id column and, for most, a template
column; id_column names the first. Those whose result depends on the order of lines take
it from row_id. Ids don't depend on partitions.
"""

from .bins import parse_ael
from .bijection import parse_iplom, parse_pliplom
from .dependency import parse_tip
from .frequency import parse_brain
from .online import parse_drain, parse_lenma, parse_spell

__all__ = ["parse_ael", "parse_brain", "parse_drain", "parse_iplom", "parse_lenma", "parse_pliplom", "parse_spell", "parse_tip"]
