"""Operations of a large-scale training-data pipeline; nothing outside this folder imports it."""
