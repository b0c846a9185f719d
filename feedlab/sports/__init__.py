"""Play-by-play folds: sport rules over the generic keyed fold."""
