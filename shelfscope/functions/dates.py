"""Date rules for review pages and review records."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# fixed values: where a date may stand in a text, and how that form is read
DATE_FORMS = (
    (r"(\d{1,2}/\d{1,2}/\d{4})", "M/d/yyyy"),
    (r"(\d{4}-\d{2}-\d{2})", "yyyy-MM-dd"),
    (r"([\p{L}\p{N}_]+ \d{1,2}, \d{4})", "MMMM d, yyyy"),
    (r"(\d{1,2} [\p{L}\p{N}_]+ \d{4})", "d MMMM yyyy"),
)
# fixed values: whole-text formats of a review date, month-first before day-first, each
# with the shape a text must have to be worth parsing (failed parses are slow)
REVIEW_DATE_FORMATS = (
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("yyyy-M-d H:m:s", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"),
    ("M/d/yyyy H:m:s", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$"),
)
# fixed values: month names and abbreviations with the month's number
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7,
    "august": 8, "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9,
    "oct": 10, "nov": 11, "dec": 12,
}

_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?$"


def parse_date(text: Column) -> Column:
    """The first date found in the text, full month names only, as DATE.

    A form is extracted and parsed only where it is found: plain conditions, so that the
    rule stays inside generated code.
    """
    found = []
    for pattern, layout in DATE_FORMS:
        piece = F.regexp_extract(text, pattern, 1)
        if "MMMM" in layout:
            piece = F.initcap(piece)
        found.append(F.when(text.rlike(pattern), F.try_to_date(piece, layout)))
    return F.coalesce(*found)


def parse_review_date(text: Column) -> Column:
    """The moment a review was written, as TIMESTAMP_NTZ.

    ISO text keeps its wall-clock time: an offset is dropped, not applied.
    """
    day = F.split_part(text, F.lit("T"), F.lit(1))
    clock = F.regexp_replace(F.split_part(text, F.lit("T"), F.lit(2)), r"[-+].*$|Z+$", "")
    iso = F.concat(day, F.lit("T"), clock)
    # hours alone are valid ISO but not a castable time
    full = F.when(F.length(clock) == 2, F.concat(iso, F.lit(":00"))).otherwise(iso)
    stamped = F.when(iso.rlike(_ISO), full.try_cast("timestamp_ntz"))
    spelled = F.coalesce(
        *[
            F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout))).cast("timestamp_ntz")
            for layout, shape in REVIEW_DATE_FORMATS
        ]
    )
    return F.when(text.contains("T"), stamped).otherwise(spelled)


def _real_day(year: Column, month: Column, day: Column) -> Column:
    iso = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(F.try_to_date(iso, "yyyy-MM-dd").isNotNull(), iso)


def parse_review_date_text(text: Column) -> Column:
    """A review date as ISO text; text that is no known date is returned unchanged."""
    numeric = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})"
    found = [
        F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text),
        F.when(
            text.rlike(numeric),
            _real_day(
                F.regexp_extract(text, numeric, 3),
                F.regexp_extract(text, numeric, 1),
                F.regexp_extract(text, numeric, 2),
            ),
        ),
    ]
    lower = F.lower(text)
    named = []
    for month, number in MONTHS.items():
        pattern = rf"{month}\s+(\d{{1,2}}),?\s+(\d{{4}})"
        named.append(
            F.when(
                lower.rlike(pattern),
                _real_day(
                    F.regexp_extract(lower, pattern, 2),
                    F.lit(f"{number:02d}"),
                    F.regexp_extract(lower, pattern, 1),
                ),
            )
        )
    # one cheap test spares texts without a month name the search for each of them
    starts = "|".join(dict.fromkeys(m[:3] for m in MONTHS))
    any_month = lower.rlike(rf"(?:{starts})[a-z]*\s+\d{{1,2}},?\s+\d{{4}}")
    found.append(F.when(any_month, F.coalesce(*named)))
    return F.coalesce(*found, text)


def parse_stored_date(text: Column) -> Column:
    """An ISO date or date-time (``Z`` or an offset allowed) as TIMESTAMP_NTZ in UTC;
    anything else is NULL."""
    iso = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?)?"
    local = F.regexp_replace(text, "Z$", "")
    shifted = F.convert_timezone(
        F.current_timezone(), F.lit("UTC"), text.try_cast("timestamp").cast("timestamp_ntz")
    )
    return F.when(local.rlike(iso + "$"), local.try_cast("timestamp_ntz")).when(
        text.rlike(iso + r"[+-]\d{2}:\d{2}$"), shifted
    )
