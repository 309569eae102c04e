"""Rule programs: their parts, checks, strata and plans."""
