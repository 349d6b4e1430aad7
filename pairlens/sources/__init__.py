from pairlens.sources.facts import pair_from_facts, read_cells
from pairlens.sources.sinks import (
    completed_runs,
    run_info_table,
    write_matrix,
    write_table,
)
from pairlens.sources.text_pair import (
    CaseLayout,
    load_case,
    load_paired,
    positional_zip,
    read_numbered_lines,
    read_text_pair,
)

__all__ = [
    "CaseLayout",
    "completed_runs",
    "load_case",
    "load_paired",
    "pair_from_facts",
    "positional_zip",
    "read_cells",
    "read_numbered_lines",
    "read_text_pair",
    "run_info_table",
    "write_matrix",
    "write_table",
]
