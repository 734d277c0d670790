"""Data work around a recommender: features, pooling, interaction, scoring, splits."""
