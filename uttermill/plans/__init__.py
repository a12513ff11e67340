"""Physical-plan helpers, whole preparation flow, registered queries and their SQL."""
