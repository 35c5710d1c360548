"""JSON text, checksums and name styles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters the platform's JSON writer escapes inside strings.
ESCAPES = {
    "<": "\\u003c",
    ">": "\\u003e",
    "&": "\\u0026",
    "\u2028": "\\u2028",
    "\u2029": "\\u2029",
}
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def escaped(json_text: Column) -> Column:
    """Apply the escapes; these characters stand only inside strings, so replacing is exact.

    Together with ``to_json`` of a variant, which keeps object fields sorted by name, this
    gives the platform's canonical JSON text.
    """
    for raw, escape in ESCAPES.items():
        json_text = F.replace(json_text, F.lit(raw), F.lit(escape))
    return json_text


#: What JSON text is made of: strings, numbers, and all else.
_TOKENS = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|-?[0-9][0-9.eE+-]*|[^"0-9-]+'


def spelled_number(token: Column) -> Column:
    """A JSON number as the platform writes it.

    Whole numbers of 64 bits stay; others are 64-bit floating-point numbers with the fewest digits that give
    the same number, with an exponent below 1e-6 and from 1e21 on. Zero has no sign. The digits are
    the runtime's; of 4,000 random numbers tried the last digit of one was not the closest, nor is that of the
    smallest number there is.
    """

    def formed(value: Column) -> Column:
        forms = (F.format_string(f"%.{p}e", value) for p in (14, 15, 16))
        return F.coalesce(*(_let(f, lambda x: F.when(x.try_cast("double") == value, x)) for f in forms))

    def parts(value: Column, form: Column) -> Column:
        mantissa = F.regexp_replace(F.substring_index(form, "e", 1), "[.-]|[.]?0+$", "")
        return F.struct(
            value.alias("value"), mantissa.alias("digits"), F.substring_index(form, "e", -1).cast("int").alias("power")
        )

    found = _let(token.try_cast("double"), lambda value: _let(formed(value), lambda form: parts(value, form)))
    return F.coalesce(token.try_cast("bigint").cast("string"), _let(found, _positioned), token)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _positioned(number: Column) -> Column:
    """A number (value, digits, power of ten of the first one) in plain or scientific form."""
    value, digits, power = number["value"], number["digits"], number["power"]
    count, one, most = F.length(digits), F.lit(1), F.lit(32)
    rest = F.when(count > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), most))).otherwise("")
    sign_of_power = F.when(power < 0, "e-").otherwise("e+")
    scientific = F.concat(F.substring(digits, one, one), rest, sign_of_power, F.abs(power).cast("string"))
    plain = (
        F.when(power < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))
        .when(power >= count - 1, F.concat(digits, F.repeat(F.lit("0"), power - count + 1)))
        .otherwise(F.concat(F.substring(digits, one, power + 1), F.lit("."), F.substring(digits, power + 2, most)))
    )
    large = (F.abs(value) < 1e-6) | (F.abs(value) >= 1e21)
    spelled = F.concat(F.when(value < 0, "-").otherwise(""), F.when(large, scientific).otherwise(plain))
    return F.when(value == 0, "0").otherwise(spelled)


def canonical_numbers(json_text: Column) -> Column:
    """JSON text with its numbers as the platform spells them; text without any fraction, exponent or long number stays."""

    def respelled(text: Column) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(_TOKENS), F.lit(0))
        whole = F.array_join(F.transform(tokens, lambda t: F.when(t.rlike("^-?[0-9]"), spelled_number(t)).otherwise(t)), "")
        return F.when(text.rlike("[0-9][.eE]|[0-9]{19}"), whole).otherwise(text)

    return _let(json_text, respelled)


def request_json(stream_class: Column, stream_id: Column, completed: Column) -> Column:
    """Spec of a backfill request as JSON; ``completed`` is left out when false."""
    return escaped(
        F.to_json(
            F.struct(
                F.coalesce(stream_class, F.lit("")).alias("streamClass"),
                F.coalesce(stream_id, F.lit("")).alias("streamId"),
                F.when(completed, F.lit(True)).alias("completed"),
            )
        )
    )


def configuration_checksum(spec_json: Column, request_spec_json: Column | None = None) -> Column:
    """md5 of the spec; with a request, both hex digests hex-encoded again and joined by a colon."""
    own = F.md5(spec_json)
    if request_spec_json is None:
        return own
    both = F.concat_ws(":", F.lower(F.hex(own)), F.lower(F.hex(F.md5(request_spec_json))))
    return F.when(request_spec_json.isNull(), own).otherwise(both)


def snake_case(name: Column) -> Column:
    """Lower case, with ``_`` only where a small letter meets a capital (a-z, A-Z)."""
    parted = F.regexp_replace(name, "([a-z])([A-Z])", "$1_$2")
    return F.translate(parted, CAPITALS, CAPITALS.lower())
