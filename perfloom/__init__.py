"""perfloom: profile, code-graph and change-set analytics as Spark plans."""
