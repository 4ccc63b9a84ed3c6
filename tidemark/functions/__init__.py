from tidemark.functions.scalars import (  # noqa: F401
    day_of_week_sun0,
    iso_text,
    micros,
    py_strip,
    truthy,
    parse_zoned_utc,
    non_blank,
)
