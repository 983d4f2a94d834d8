"""Ablations, weight tables, rankings, embeddings, folding, linear models, learners and validation."""
