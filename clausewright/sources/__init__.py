"""Sources and sinks: file scans, chunk and graph tables, run logs."""
