"""DataFrame operators over lines, facts and verdicts."""
