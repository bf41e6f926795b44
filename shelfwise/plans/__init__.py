"""shelfwise.plans."""
