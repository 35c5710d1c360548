"""Surrogates for personal data, with column functions only.

Detected: email and IP addresses, phone, card, social-security and account numbers, and
persons named with a title. A person's name is taken word by word, so that a later "Mr Smith" or
"Mr John" stays the same person as "Mr John Smith"; whether a word is a given or a family name, which
only decides the ending of its surrogate, is settled once by all its mentions. Where a text names a
person with a title, that name's words are replaced in all of this text, if spelled with a capital, with or
without a title before them (so are words that only look like the name). Each entity (kind, normalised value) draws a keyed
digest that picks its surrogate: letters for letters and digits for digits in the same shape
(top-level domains, leading digits and country codes stay, card numbers get a valid check
digit), IP addresses for IP addresses, and names spelled from syllables of the same script
with an ending of the title's gender.

A surrogate may not equal any entity found in the corpus nor another's surrogate. Of those that
meet, the smallest keeps it and the others draw again with the next number, until none is
left: different entities stay different, and equal ones equal, over all documents. Where a format has
too few values, those still left after every third draw get one more character or syllable.

Cases: null text stays null; texts without entities pass unchanged and are not moved; equal
texts are worked out once, by their digest, so any number of copies gets the same result; an
entity that stands in a large part of all texts is a skewed join key, which Spark splits; an
empty table gives no rows; all columns of ``docs`` are kept.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwright.llm.shared import settled

TITLES = {
    "m": r"Mr|Mister|Herr|Señor|Sr|Monsieur|господин|г-н|κύριος",
    "f": r"Mrs|Ms|Miss|Frau|Señora|Sra|Mme|Madame|госпожа|г-жа|κυρία",
}
#: A capital and letters, parts behind an apostrophe or hyphen too, but no genitive.
_NAME = r"\p{Lu}\p{L}*(?:['’-](?![sS](?!\p{L}))\p{L}+)*"
_TOKEN = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*|[^\p{L}\p{N}]+"
_TITLE = rf"(?:{TITLES['m']}|{TITLES['f']})\.?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"

#: Kind and pattern; where several could begin, the first counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": rf"(?<![\p{{L}}\p{{N}}]){_TITLE}\s+{_NAME}(?:\s+{_NAME}){{0,2}}",
    "social": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11}"
    r"|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every mention has: a digit, an at sign or a title. Cheap to look for in texts without any.
SIGNS = rf"[0-9@]|(?=[MHFSгκ])(?:{TITLES['m']}|{TITLES['f']})\.?\s"

_CONSONANTS = {"latin": "bdfghjklmnprstv", "cyrillic": "бдгклмнпрств", "greek": "βδγκλμνπρστ"}
_VOWELS = {"latin": "aeio", "cyrillic": "аеио", "greek": "αειο"}
SYLLABLES = {s: [c + v for c in _CONSONANTS[s] for v in _VOWELS[s]] for s in _CONSONANTS}
#: Endings of given names by gender, and of family names.
ENDINGS = {
    "latin": {
        "m": ["n", "rd", "l", "s"],
        "f": ["lia", "nna", "ra", "lla"],
        "family": ["son", "mann", "ler", "dez", "rin", "ley"],
    },
    "cyrillic": {
        "m": ["н", "р", "л", "й"],
        "f": ["лия", "нна", "ра", "лла"],
        "family": ["ков", "нов", "рин", "ленко"],
    },
    "greek": {"m": ["ς", "νος", "ρης"], "f": ["νη", "ρα", "λία"], "family": ["δης", "πουλος", "κης"]},
}
#: Draws of one width; what is then left draws from a wider format.
DRAWS = 3


def _script(word: Column) -> Column:
    return (
        F.when(word.rlike(r"\p{IsCyrillic}"), F.lit("cyrillic")).when(word.rlike(r"\p{IsGreek}"), F.lit("greek")).otherwise("latin")
    )


def _parts(mention: Column) -> Column:
    """A mention as structs (kind, norm, raw); parts that stay as they are have no kind."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        kind = F.when(mention.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(kind)

    def part(kind: Column, norm: Column, raw: Column) -> Column:
        return F.struct(kind.alias("kind"), norm.alias("norm"), raw.alias("raw"))

    tokens = F.regexp_extract_all(mention, F.lit(r"\s+|\S+"), F.lit(0))
    gender = F.when(mention.rlike(rf"^(?:{TITLES['f']})\.?\s"), F.lit("f")).otherwise("m")

    def of_name(token: Column, k: Column) -> Column:
        stays = (k == 0) | token.rlike(r"^\s")
        # A name of one word says nothing of its role.
        role = F.when(F.size(tokens) == 3, F.lit("sole")).when(k == F.size(tokens) - 1, F.lit("family")).otherwise(gender)
        return part(
            F.when(~stays, F.concat_ws(":", F.lit("name"), role, _script(token))), F.lower(token), token
        )

    norm = F.when(kind.isin("email"), F.lower(mention)).when(kind == "ip", mention)
    norm = F.coalesce(norm, F.regexp_replace(mention, "[^A-Za-z0-9]", ""))
    return F.when(kind == "person", F.transform(tokens, of_name)).otherwise(F.array(part(kind, norm, mention)))


def _space(kind: Column) -> Column:
    """What a value is known by besides its text: the kind, for names without the role."""
    return F.regexp_replace(kind, "^name:[a-z]+:", "name:")


def _entities(parts: DataFrame) -> DataFrame:
    """(kind, norm) of distinct entities; a name word has the role of most of its mentions, or else is a family name."""
    role = F.get(F.split("kind", ":"), F.lit(1))
    n_family, n_m, n_f = (F.coalesce(F.sum((role == r).cast("int")), F.lit(0)) for r in ("family", "m", "f"))
    named = parts.filter("kind IS NOT NULL").groupBy(_space(F.col("kind")).alias("space"), "norm")
    settled_role = F.when(n_family >= n_m + n_f, "family").when(n_m >= n_f, "m").otherwise("f")
    return named.agg(settled_role.alias("role")).select(
        F.when(F.col("space").startswith("name:"), F.regexp_replace("space", "^name:", F.concat(F.lit("name:"), "role", F.lit(":"))))
        .otherwise(F.col("space"))
        .alias("kind"),
        "norm",
    )


def _byte(digest: Column, k: Column) -> Column:
    return F.conv(F.substring(digest, (k % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _digest(key: str, attempt: int) -> Column:
    """128 hexadecimal digits that ``key`` and ``attempt`` decide for an entity (kind, norm)."""
    inner = F.sha2(F.concat_ws("\u0001", F.lit(key), "kind", "norm", F.lit(str(attempt))).cast("binary"), 256)
    return F.sha2(F.concat(F.lit(key), inner).cast("binary"), 512)


def _surrogate(kind: Column, norm: Column, digest: Column, wider: int = 0) -> Column:
    """Normalised surrogate of an entity, ``wider`` characters or syllables longer than its format."""
    # A long value needs more than 64 bytes; its later blocks draw their own.
    drawn = lambda k: (_byte(digest, k) + F.floor(k / 64).cast("int") * 7).cast("int")

    kept_head = F.when(kind == "account", F.lit(2)).when(kind.isin("phone", "card"), F.lit(1)).otherwise(F.lit(0))
    kept_tail = F.when(kind == "email", F.length(F.regexp_extract(norm, r"\.[a-z]+$", 0))).otherwise(F.lit(0))

    def shaped(c: Column, k: Column) -> Column:
        kept = (k < kept_head) | (k >= F.length(norm) - kept_tail)
        digit = F.char(F.lit(48) + drawn(k) % 10)
        small, large = F.char(F.lit(97) + drawn(k) % 26), F.char(F.lit(65) + drawn(k) % 26)
        return (
            F.when(kept, c).when(c.rlike("[0-9]"), digit).when(c.rlike("[a-z]"), small).when(c.rlike("[A-Z]"), large).otherwise(c)
        )

    shape = F.array_join(F.transform(F.split(norm, ""), shaped), "")
    octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (_byte(digest, k) % 254 + 1).cast("string"))
    more = [_byte(digest, F.lit(40 + k)) for k in range(min(wider, 20))]
    letters, digits = (F.concat(F.lit(""), *(F.char(F.lit(first) + b % size) for b in more)) for first, size in ((97, 26), (48, 10)))
    value = (
        F.when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "card", _with_check_digit(F.concat(shape, digits)))
        .when(kind == "email", F.concat(letters, shape))
        .otherwise(F.concat(shape, digits))
    )
    for script, syllables in SYLLABLES.items():
        pool = F.array(*map(F.lit, syllables))
        body = F.transform(
            F.sequence(F.lit(0), F.lit(1 + wider) + _byte(digest, F.lit(60)) % 2), lambda k: pool[_byte(digest, k) % len(syllables)]
        )
        for role, endings in ENDINGS[script].items():
            ending = F.array(*map(F.lit, endings))[_byte(digest, F.lit(61)) % len(endings)]
            value = F.when(kind == f"name:{role}:{script}", F.concat(F.array_join(body, ""), ending)).otherwise(value)
    return value


def _with_check_digit(number: Column) -> Column:
    """The number with its last digit set so that the Luhn sum is a multiple of ten."""
    rest = F.reverse(F.split(F.substring(number, F.lit(1), F.length(number) - 1), ""))
    doubled = F.transform(
        rest,
        lambda c, k: F.when(k % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")),
    )
    total = F.aggregate(doubled, F.lit(0), lambda s, x: s + x)
    return F.concat(F.substring(number, F.lit(1), F.length(number) - 1), ((10 - total % 10) % 10).cast("string"))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, value) of distinct entities (kind, norm), no two values of a kind alike and none an entity.
    Names of one script are one kind here."""
    entities = settled(entities.distinct(), "surrogate-entities")
    taken = entities.select(_space(F.col("kind")).alias("space"), F.col("norm").alias("value"))
    done, pending = None, entities
    for attempt in count():
        drawn = settled(
            pending.withColumn("digest", _digest(key, attempt)).select(
                "kind",
                "norm",
                _surrogate(F.col("kind"), F.col("norm"), F.col("digest"), attempt // DRAWS).alias("value"),
                _space(F.col("kind")).alias("space"),
            ),
            "surrogate-draws",
        )
        free = drawn.join(taken, ["space", "value"], "left_anti")
        if done is not None:
            free = free.join(done.select("space", "value"), ["space", "value"], "left_anti")
        won = free.groupBy("space", "value").agg(F.min(F.struct("norm", "kind")).alias("first"))
        won = settled(won.select("space", "value", "first.norm", "first.kind"), "surrogate-map")
        done = won if done is None else done.unionByName(won)
        pending = drawn.join(won, ["kind", "norm"], "left_anti").select("kind", "norm")
        if pending.isEmpty():
            return done.select("kind", "norm", "value")


def _capitals(raw: Column, value: Column) -> Column:
    capital = F.concat(F.upper(F.substring(value, 1, 1)), F.substring(value, 2, 1 << 20))
    return F.when(raw == F.upper(raw), F.upper(value)).when(raw == F.lower(raw), value).otherwise(capital)


def _without_genitive(token: Column) -> Column:
    return F.regexp_replace(token, "['’][sS]$", "")


def _tokens(piece: Column) -> Column:
    return F.regexp_extract_all(piece, F.lit(_TOKEN), F.lit(0))


def _is_name(token: Column, names: Column) -> Column:
    known = F.map_contains_key(names, F.lower(token)) | F.map_contains_key(names, F.lower(_without_genitive(token)))
    return token.rlike(r"^\p{Lu}") & known


def _renamed(piece: Column, names: Column) -> Column:
    """A stretch between mentions with its capitalised words replaced by ``names`` (lower-cased word to surrogate)."""

    def word(token: Column) -> Column:
        stem = _without_genitive(token)
        rest = F.substring(token, F.length(stem) + 1, F.lit(1 << 20))
        whole, first = (F.element_at(names, F.lower(x)) for x in (token, stem))
        new = F.coalesce(_capitals(token, whole), F.concat(_capitals(stem, first), rest))
        return F.when(_is_name(token, names), new).otherwise(token)

    return F.array_join(F.transform(_tokens(piece), word), "")


def _rendered(kind: Column, raw: Column, value: Column) -> Column:
    """The surrogate in the spelling of the mention: same signs, spaces and capitals."""
    name = _capitals(raw, value)
    signs = F.regexp_replace(value, "[^A-Za-z0-9]", "")
    # Each letter or digit of the mention gives way to the next one of the surrogate; what a wider one has more goes
    # before an address and behind a number.
    more = F.when(kind == "email", F.length(signs) - F.length(F.regexp_replace(raw, "[^A-Za-z0-9]", ""))).otherwise(0)
    filled = F.aggregate(
        F.split(raw, ""),
        F.struct(more.alias("k"), F.substring(signs, F.lit(1), more).alias("out")),
        lambda s, c: F.when(
            c.rlike("[A-Za-z0-9]"),
            F.struct(
                (s["k"] + 1).alias("k"),
                F.concat(
                    s["out"],
                    F.when(c.rlike("[A-Z]"), F.upper(F.substring(signs, s["k"] + 1, F.lit(1)))).otherwise(
                        F.substring(signs, s["k"] + 1, F.lit(1))
                    ),
                ).alias("out"),
            ),
        ).otherwise(F.struct(s["k"].alias("k"), F.concat(s["out"], c).alias("out"))),
        lambda s: F.concat(s["out"], F.substring(signs, s["k"] + 1, F.lit(1 << 20))),
    )
    return F.when(kind.isNull(), raw).when(kind.startswith("name:"), name).when(kind == "ip", value).otherwise(filled)


def replaced(docs: DataFrame, key: str, count: str = "n_replaced") -> DataFrame:
    """``docs`` with personal data in ``text`` replaced, and the number of replaced mentions added as ``count``."""
    found = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    holds = F.coalesce(F.col("text").rlike(SIGNS) & F.col("text").rlike(ANY), F.lit(False))
    digest = F.md5(F.col("text").cast("binary"))
    texts = docs.filter(holds).select(digest.alias("_key"), F.array_distinct(found).alias("mentions"))
    texts = texts.groupBy("_key").agg(F.first("mentions").alias("mentions"))
    mentions = texts.select("_key", F.explode("mentions").alias("mention"))
    parts = settled(
        mentions.select("_key", "mention", F.posexplode(_parts(F.col("mention"))).alias("k", "part")).select(
            "_key", "mention", "k", "part.*"
        ),
        "surrogate-mentions",
    )
    table = surrogates(_entities(parts), key).select(_space(F.col("kind")).alias("space"), "norm", "value")
    spelled = parts.withColumn("space", _space(F.col("kind"))).join(table, ["space", "norm"], "left").withColumn(
        "new", _rendered(F.col("kind"), F.col("raw"), F.col("value"))
    )
    whole = spelled.groupBy("_key", "mention").agg(
        F.array_sort(F.collect_list(F.struct("k", "new"))).alias("parts"),
        F.collect_list(F.when(F.col("kind").startswith("name:"), F.struct("norm", "value"))).alias("names"),
    )
    whole = whole.select("_key", F.struct("mention", F.array_join(F.col("parts.new"), "").alias("new")).alias("pair"), "names")
    maps = whole.groupBy("_key").agg(
        F.map_from_entries(F.collect_list("pair")).alias("_map"),
        F.map_from_entries(F.array_distinct(F.flatten(F.collect_list("names")))).alias("_names"),
    )
    names = F.col("_names")
    gaps = F.split("text", ANY, -1)
    # Most texts name nobody; their words are not looked at.
    pieces = F.when(F.size(names) > 0, F.transform(gaps, lambda p: _renamed(p, names))).otherwise(gaps)
    untitled = F.when(
        F.size(names) > 0,
        F.aggregate(gaps, F.lit(0), lambda n, p: n + F.size(F.filter(_tokens(p), lambda t: _is_name(t, names)))),
    ).otherwise(0)
    text = F.array_join(
        F.zip_with(pieces, found, lambda p, m: F.concat(p, F.coalesce(F.element_at(F.col("_map"), m), F.lit("")))), ""
    )
    others = [c for c in docs.columns if c != count]
    changed = docs.filter(holds).withColumn("_key", digest).join(maps, "_key")
    changed = changed.select(*(text.alias(c) if c == "text" else c for c in others), (F.size(found) + untitled).cast("long").alias(count))
    return docs.filter(~holds).select(*others, F.lit(0).cast("long").alias(count)).unionByName(changed)
