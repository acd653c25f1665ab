"""Column expressions; all run inside the JVM."""

from flowloop.functions.addresses import ADDRESS_FORMS, inet_aton_to_long, ip_to_long
from flowloop.functions.answers import answer_to_bit
from flowloop.functions.identifiers import random_id
from flowloop.functions.timerange import as_utc, in_window, period_of, periods_between

__all__ = [
    "ADDRESS_FORMS",
    "answer_to_bit",
    "as_utc",
    "in_window",
    "inet_aton_to_long",
    "ip_to_long",
    "period_of",
    "periods_between",
    "random_id",
]
