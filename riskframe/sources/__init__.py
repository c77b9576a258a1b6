"""Sources and sinks."""

from riskframe.sources.io import (  # noqa: F401
    Field, Timer, link_mortality, numeric_only, parse_fixed_width, read_cycles, read_fixed_width,
    read_table, schema_table, sink_and_reload, to_fixed_width, union_cycles, write_table,
)
