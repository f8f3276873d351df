from strideframe.sources.landing import RAW_FILES, RawSources  # noqa: F401
