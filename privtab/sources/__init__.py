from privtab.sources.tables import (
    accepted,
    existing,
    load,
    profile,
    read_first,
    read_table,
    refused,
    resolve_target,
    write_table,
)

__all__ = ["accepted", "existing", "load", "profile", "read_first", "read_table",
           "refused", "resolve_target", "write_table"]
