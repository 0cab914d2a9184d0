"""Reading and writing event logs, rules, presets and snapshots."""
