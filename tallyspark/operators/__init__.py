"""DataFrame operators: joins, ledger controls, candidates, proposals, groups, duplicates and usage."""
