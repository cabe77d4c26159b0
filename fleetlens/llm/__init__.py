"""Operations of a training-data pipeline: quality, language model scores,
mixing, exact search, language, near-duplicates, URL filters,
decontamination, sharding and line deduplication.

Nothing else in the library imports this subpackage. ``catalog`` holds the
registered queries; each operator has a module of its own.
"""
