"""Operations of a training-data pipeline: rules, deduplication, decontamination, mixing, formatting, classifiers."""
