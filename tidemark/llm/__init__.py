"""Operations of a training-data pipeline; ``queries`` applies each to its whole table."""
