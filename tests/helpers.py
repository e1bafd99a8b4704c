"""Small frames for hand-written cases."""

from datetime import date, timedelta

from larder import params as P

SALES_COLUMNS = [f.name for f in P.RAW_SALES]
FEATURE_SALES = (
    "Store int, Date date, Sales double, Customers int, Promo int, Open int, StateHoliday string, "
    "SchoolHoliday int, is_holiday int, is_promo_day int"
)


def raw_rows(spark, *changes):
    """Raw sales rows, each a good row with the given changes."""
    good = {
        "Store": 1,
        "DayOfWeek": 4,
        "Date": "2013-01-03",
        "Sales": 100.0,
        "Customers": 10,
        "Open": 1,
        "Promo": 0,
        "StateHoliday": "0",
        "SchoolHoliday": 0,
    }
    rows = [tuple((good | change)[c] for c in SALES_COLUMNS) for change in changes]
    return spark.createDataFrame(rows, P.RAW_SALES)


def series(spark, values, store=1, start=date(2020, 1, 1), gaps=()):
    """A store-day panel with the given sales on consecutive days, leaving out the gaps."""
    rows = [
        (store, start + timedelta(days=i), v, 10, i % 2)
        for i, v in enumerate(values)
        if i not in gaps
    ]
    return spark.createDataFrame(
        rows, "Store int, Date date, Sales double, Customers int, Promo int"
    )
