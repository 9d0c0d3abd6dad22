"""Sources and sinks: driver tables, fixture views, pay files, ledger and report writers."""
