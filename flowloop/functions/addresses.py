"""IPv4 text to number."""

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DOTTED_QUAD = rf"^{_OCTET}(?:\.{_OCTET}){{3}}\z"


def ip_to_long(ip: Column) -> Column:
    """The dotted-quad address as an unsigned 32-bit number, else null.

    Short forms, leading zeros, signs, blanks and trailing text are no dotted
    quad. The expression is kept small: a few copies of it must fit into one
    generated method that the JVM still compiles.
    """
    front, back = F.substring_index(ip, ".", 2), F.substring_index(ip, ".", -2)
    a, b, c, d = (
        F.substring_index(half, ".", side).try_cast("bigint")
        for half in (front, back)
        for side in (1, -1)
    )
    number = a * 256**3 + b * 256**2 + c * 256 + d
    return F.when(ip.rlike(_DOTTED_QUAD), number)


# Numbers as C writes them, with no more digits than 32 bits can need.
_C_NUMBER = "(?:0[xX]0*[0-9a-fA-F]{1,8}|0+[1-7][0-7]{0,10}|0+|[1-9][0-9]{0,9})"
_C_ADDRESS = rf"^{_C_NUMBER}(?:\.{_C_NUMBER}){{0,3}}\z"


def inet_aton_to_long(ip: Column) -> Column:
    """The number of every form the C library's ``inet_aton`` takes, else null.

    One to four decimal, octal or hex numbers, of which the last fills the remaining
    bytes; text after a blank is ignored. Slower than ``ip_to_long``.
    """
    address = F.regexp_replace(ip, r"(?s)[ \t\n\x0B\f\r].*", "")
    parts = F.split(address, r"\.")
    count = F.size(parts)

    def part(text: Column, place: Column) -> Column:
        digits = F.when(text.rlike("^0[xX]"), F.conv(F.substring(text, 3, 2**31 - 1), 16, 10))
        digits = digits.when(text.startswith("0"), F.conv(text, 8, 10)).otherwise(text)
        last = place == count - 1
        number = digits.try_cast("bigint")
        size = F.when(last, F.lit(5) - count).otherwise(1) * 8
        shift = F.when(last, 0).otherwise(F.lit(24) - place * 8)
        one = F.lit(1).cast("bigint")
        fits = number < F.call_function("shiftleft", one, size)
        return F.when(fits, F.call_function("shiftleft", number, shift))

    total = F.aggregate(
        F.transform(parts, part), F.lit(0).cast("bigint"), lambda total, number: total + number
    )
    return F.when(address.rlike(_C_ADDRESS), total)


ADDRESS_FORMS = {"dotted_quad": ip_to_long, "inet_aton": inet_aton_to_long}
