"""Personal data replaced by surrogates, with DataFrame operations only.

Entities: e-mail addresses, telephone numbers, payment cards, social security numbers, IBANs, IPv4
addresses, access keys, assigned secrets (password=..., token: "...") and names after a title.  An
entity's surrogate is drawn from SHA-256 of (key, kind, normal form, attempt): the same entity has the
same surrogate wherever and however it is written (coreference), nothing is kept that could undo it,
and it is dressed as the entity was: digits stand where digits stood, letters of a script where letters of
that script stood, upper case where upper case stood.  Cards (numbers with a valid check digit) keep their
issuer's digit and validity, telephone numbers their country code (after + or 00; a North American number
without it is the same entity as with it), IBANs their country and get valid check digits, keys keep their
prefix, names the gender of their title and their script.  Parts of a name are entities of their own, so
`Mrs. Ada Byron`, `Mrs. Byron` and a later `Byron` in the same text agree.

Distinctness: all entities of the corpus and their surrogates are compared; of two with the same
surrogate, and for a surrogate that is itself an entity of the corpus, the attempt is raised until none
collides; names of all genders and family names are compared with each other.  Surrogates of free length grow with
the attempt, so crowded short forms find room; if ROUNDS attempts leave collisions (a fixed format is
all used up), an error says so.  Only documents that hold such an entity need the table of raised attempts; for all
others the surrogate is an expression of the text alone and the documents don't move.

Defined results: null texts stay null, texts without entities stay as they are; a secret without a letter or
digit (`password: ********`) is no entity; null and repeated ids are treated by their text; an empty table
gives no rows; other columns pass through untouched whatever their names are, also
if they carry the name of a result column (then the result replaces it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# Titles by gender, and syllables that names are made of.
MALE_TITLES = ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "господин", "г-н", "Κύριος", "κ"]
FEMALE_TITLES = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа", "госпожа", "г-жа", "Κυρία", "κα"]
OTHER_TITLES = ["Dr", "Prof"]
LATIN = ["al", "ba", "bel", "cor", "da", "del", "er", "fa", "gar", "han", "il", "jo", "ka", "lan", "mar", "mi", "na", "nor", "ol", "pa", "per", "ra", "ro", "sal", "sen", "ta", "tor", "ul", "van", "ver", "wil", "yor"]
CYRILLIC = ["ал", "ба", "бел", "вар", "вол", "га", "гор", "да", "дем", "ер", "жа", "зо", "ил", "ка", "кор", "лан", "ле", "мар", "ми", "на", "ник", "ор", "па", "пет", "ра", "ром", "са", "сев", "та", "тим", "фе", "юр"]
GREEK = ["αλ", "βα", "γα", "δη", "ερ", "ζη", "θε", "ιλ", "κα", "κορ", "λαμ", "λε", "μαρ", "μι", "να", "νικ", "ορ", "πα", "πετ", "ρα", "ρο", "σα", "σταυ", "τα", "τιμ", "φι", "χρι", "ψα"]
ENDINGS = {
    "male": {"latin": ["o", "en", "ard", "us", "on", "ert", "im", "ias"], "cyrillic": ["ан", "ил", "ей", "ор", "ир", "им", "ий", "ав"], "greek": ["ος", "ης", "ας", "ων", "έας", "ις", "ιος", "άς"]},
    "female": {"latin": ["a", "ina", "elle", "ia", "ette", "ara", "is", "ine"], "cyrillic": ["а", "ина", "ия", "ья", "ела", "ара", "на", "ита"], "greek": ["α", "η", "ία", "ούλα", "ώ", "ένα", "ίνα", "άνα"]},
    "other": {"latin": ["el", "in", "an", "y", "is", "ey", "e", "ar"], "cyrillic": ["я", "и", "а", "ша", "ня", "ка", "ля", "ся"], "greek": ["ι", "υς", "άκης", "ος", "ου", "ίτσα", "ας", "ης"]},
    "family": {"latin": ["son", "berg", "mann", "ley", "ton", "ez", "ier", "feld"], "cyrillic": ["ов", "ин", "ский", "енко", "ев", "ук", "ян", "ых"], "greek": ["όπουλος", "ίδης", "άκης", "έας", "άκος", "ιάδης", "άτος", "ούδης"]},
}
# Country calling codes of one and two digits; all others have three.
CALLING_CODE = "^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: Attempts at a surrogate; from WIDER on, those of free length grow.
ROUNDS, WIDER = 60, 4

_TITLES = "|".join([*MALE_TITLES, *FEMALE_TITLES, *OTHER_TITLES])
_NAME = r"\p{Lu}[\p{L}'’]+(?:-\p{Lu}[\p{L}'’]+)?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# In the order in which they are tried at a place.
PATTERNS = {
    "secret": r"(?i:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key)[\"']?[ ]{0,2}[:=][ ]{0,2}[\"']?[A-Za-z0-9+/_.~!@#$%^&*-]{6,}",
    "email": r"[\p{L}\p{N}][\p{L}\p{M}\p{N}._%+-]*@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "key": r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    "iban": r"[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "card": r"[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d])|3\d{3}[ -]?\d{6}[ -]?\d{5}(?!\d)",
    "ssn": r"\d{3}-\d{2}-\d{4}(?!\d)",
    "ip": rf"(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "phone": r"(?:\+|00(?=\d*[ .(-]))1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?:\+|00(?=\d*[ .(-]))\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[-. ]\d{4}(?!\d)|\d{3}[-.]\d{3}[-.]\d{4}(?!\d)",
    "person": rf"(?:{_TITLES})\.? {_NAME}(?: {_NAME}){{0,2}}",
}
_ANY = r"(?<![\p{L}\p{N}_])(?:" + "|".join(PATTERNS.values()) + ")"
_SECRET_HEAD = r"^(?i:[a-z_-]+)[\"']?[ ]{0,2}[:=][ ]{0,2}[\"']?"


def _let(value: Column, then) -> Column:
    """then(value), with the value written and computed once however often it is used."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _kind(m: Column) -> Column:
    """The kind of a match; what only looks like a card (its check digit is wrong) or a secret (all symbols) is no entity."""
    out = F.lit("person")
    for kind in reversed(list(PATTERNS)[:-1]):
        named = F.lit(kind)
        if kind == "card":
            named = F.when(_luhn_sum(F.regexp_replace(m, "[^0-9]", "")) % 10 == 0, kind).otherwise("number")
        elif kind == "secret":
            named = F.when(F.regexp_replace(m, _SECRET_HEAD, "").rlike("[A-Za-z0-9]"), kind).otherwise("number")
        out = F.when(m.rlike(f"^(?:{PATTERNS[kind]})$"), named).otherwise(out)
    return out


def _matches(text: Column) -> Column:
    """The matches of a text as (m, kind)."""
    return F.transform(F.regexp_extract_all(text, F.lit(_ANY), 0), lambda m: F.struct(m.alias("m"), _kind(m).alias("kind")))


def _gender(title: Column) -> Column:
    bare = F.regexp_replace(title, r"\.$", "")
    return F.when(bare.isin(MALE_TITLES), "male").when(bare.isin(FEMALE_TITLES), "female").otherwise("other")


def _units(m: Column, kind: Column) -> Column:
    """The entities of a match: kind, normal form, and how it was written."""
    unit = lambda k, norm, surface: F.struct(k.alias("kind"), norm.alias("norm"), surface.alias("surface"))
    value = F.when(kind == "secret", F.regexp_replace(m, _SECRET_HEAD, "")).otherwise(m)
    digits = F.regexp_replace(m, r"[^0-9]", "")
    called = F.when(m.startswith("00"), F.substring(digits, F.lit(3), F.length(digits))).when(m.startswith("+"), digits).otherwise(F.concat(F.lit("1"), digits))
    norm = F.when(kind == "email", F.lower(m)).when(kind == "phone", called).when(kind.isin("card", "ssn"), digits).when(kind == "iban", F.regexp_replace(m, " ", "")).otherwise(value)
    names = lambda words: F.transform(F.slice(words, 2, 3), lambda w, i: unit(F.when(i == F.size(words) - 2, "family").otherwise(_gender(words[0])), F.lower(w), w))
    return F.when(kind == "person", _let(F.split(m, " "), names)).otherwise(F.array(unit(kind, norm, value)))


def _pick(d: Column, i: Column | int, n: Column | int) -> Column:
    return F.pmod(F.xxhash64(d, F.lit(i) if isinstance(i, int) else i), (F.lit(n) if isinstance(n, int) else n).cast("long")).cast("int")


def _one_of(values: str | Column, d: Column, i: Column | int) -> Column:
    """A character of a string, or an element of an array column."""
    if isinstance(values, str):
        return F.substring(F.lit(values), _pick(d, i, len(values)) + 1, F.lit(1))
    return F.element_at(values, _pick(d, i, F.size(values)) + 1)


def _table(rows: dict[str, list[str]]) -> Column:
    """A map from names to lists, as one literal."""
    return F.str_to_map(F.lit(";".join(f"{k}={'|'.join(v)}" for k, v in rows.items())), F.lit(";"), F.lit("="))


_CHARS = r"(?s)(.)"
_LOW, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_CYRILLIC_LOW, _GREEK_LOW = "абвгдежзиклмнопрстуфхцчшэюя", "αβγδεζηθικλμνξοπρστυφχψω"


def _shape(s: Column, d: Column, keep: Column, hexed: Column) -> Column:
    """Letters for letters of a script and case, digits for digits, the rest and the first `keep` characters as they are."""

    def to(c: Column, i: Column) -> Column:
        letter = F.when(c.rlike(r"\p{IsCyrillic}"), _one_of(_CYRILLIC_LOW, d, i)).when(c.rlike(r"\p{IsGreek}"), _one_of(_GREEK_LOW, d, i)).when(hexed, _one_of("abcdef", d, i)).otherwise(_one_of(_LOW, d, i))
        return F.when(i < keep, c).when(c.rlike(r"\d"), _one_of(_DIGITS, d, i)).when(c.rlike(r"\p{L}"), _let(letter, lambda x: F.when(c.rlike(r"\p{Lu}"), F.upper(x)).otherwise(x))).otherwise(c)

    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(_CHARS), 1), to), "")


def _more(attempt: Column, d: Column) -> Column:
    """Letters that late attempts add, so that there is room beyond a crowded short form."""
    return F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), attempt - WIDER + 1)), lambda i: F.when(attempt < WIDER, "").otherwise(_one_of(_LOW, d, i + 500))), "")


def _mod_97(s: Column) -> Column:
    """The remainder of a string of digits and capital letters (A = 10 to Z = 35), as IBANs are checked."""
    chars = F.regexp_extract_all(s, F.lit(_CHARS), 1)
    return F.aggregate(chars, F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))))


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one not doubled."""
    d = F.reverse(F.regexp_extract_all(digits, F.lit(_CHARS), 1))
    worth = F.transform(d, lambda c, i: F.when(i % 2 == 0, c.cast("int")).when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2))
    return F.aggregate(worth, F.lit(0), lambda a, x: a + x)


def _name(kind: Column, norm: Column, attempt: Column, d: Column) -> Column:
    """Syllables, one more with each attempt, and an ending of the gender; in other scripts letters of the name's own."""
    script = F.when(norm.rlike(r"\p{IsGreek}"), "greek").when(norm.rlike(r"\p{IsCyrillic}"), "cyrillic").when(norm.rlike(r"\p{IsLatin}"), "latin").otherwise("")
    syllables = _table({"latin": LATIN, "cyrillic": CYRILLIC, "greek": GREEK})
    endings = _table({f"{gender} {k}": v for gender, scripts in ENDINGS.items() for k, v in scripts.items()})
    listed = lambda table, entry: F.split(F.element_at(table, entry), r"\|")
    known = lambda k: F.concat(F.array_join(F.transform(F.sequence(F.lit(0), attempt + 1), lambda i: _one_of(listed(syllables, k), d, i)), ""), _one_of(listed(endings, F.concat_ws(" ", kind, k)), d, 99))
    own = F.array_join(F.transform(F.sequence(F.lit(1), F.length(norm) + attempt), lambda i: _one_of(F.regexp_extract_all(norm, F.lit(_CHARS), 1), d, i)), "")
    return _let(script, lambda k: F.when(k == "", own).otherwise(known(k)))


def _fake(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a normal form, in normal form."""

    def drawn(d: Column) -> Column:
        tail = F.regexp_extract(norm, r"(\.\p{L}{2,})$", 1)
        ip = F.concat_ws(".", *[(_pick(d, i, n) + a).cast("string") for i, (a, n) in enumerate(((11, 200), (0, 256), (0, 256), (1, 254)))])
        changed = F.when(kind == "email", F.substring(norm, F.lit(1), F.length(norm) - F.length(tail))).when(kind == "card", F.substring(norm, F.lit(1), F.length(norm) - 1)).when(kind == "iban", F.substring(norm, F.lit(5), F.length(norm))).otherwise(norm)
        keep = F.when(kind == "phone", F.length(F.regexp_extract(norm, CALLING_CODE, 0))).when(kind == "card", 1).when(kind == "key", 4).otherwise(0)
        shaped = _shape(changed, d, keep, (kind == "secret") & norm.rlike("^[0-9a-f]+$"))
        country = F.substring(norm, 1, 2)

        def closed(x: Column) -> Column:
            return (
                F.when(kind == "email", F.concat(_more(attempt, d), x, tail))
                .when(kind == "card", F.concat(x, ((10 - _luhn_sum(F.concat(x, F.lit("0"))) % 10) % 10).cast("string")))
                .when(kind == "iban", F.concat(country, F.lpad((98 - _mod_97(F.concat(x, country, F.lit("00")))).cast("string"), 2, "0"), x))
                .when(kind == "key", F.upper(x))
                .when(kind == "secret", F.concat(x, _more(attempt, d)))
                .otherwise(x)
            )

        return F.when(kind.isin(*ENDINGS), _name(kind, norm, attempt, d)).when(kind == "ip", ip).otherwise(_let(shaped, closed))

    return _let(F.sha2(F.concat_ws("\u0001", F.lit(key), kind, norm, attempt.cast("string")), 256), drawn)


def _dress(kind: Column, fake: Column, surface: Column) -> Column:
    """A surrogate written as the entity was."""
    chars = F.regexp_extract_all(surface, F.lit(_CHARS), 1)
    woven = lambda to: F.array_join(F.transform(chars, to), "")
    at = lambda i: F.substring(fake, i, F.lit(1))
    seen = lambda i, out: F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), out, ""))
    # a telephone number without its country code takes the last digits; the zeros before a country code stay
    zeros = F.when((kind == "phone") & surface.startswith("00"), 2).otherwise(0)
    skip = F.when((kind != "phone") | surface.startswith("+") | surface.startswith("00"), -zeros).otherwise(F.length(fake) - F.length(F.regexp_replace(surface, "[^0-9]", "")))
    digits = woven(lambda c, i: _let(seen(i, "[^0-9]"), lambda n: F.when(c.rlike("[0-9]") & (n > zeros), at(n + skip)).otherwise(c)))
    longer = F.length(fake) - F.length(surface)
    cased = F.concat(F.substring(fake, F.lit(1), longer), woven(lambda c, i: _let(at(i + 1 + longer), lambda x: F.when(c.rlike(r"\p{Lu}"), F.upper(x)).otherwise(x))))
    spaced = woven(lambda c, i: F.when(c == " ", c).otherwise(at(seen(i, " "))))
    name = F.when(surface.rlike(r"^\p{Lu}{2,}$"), F.upper(fake)).otherwise(F.concat(F.upper(F.substring(fake, 1, 1)), F.substring(fake, F.lit(2), F.length(fake))))
    return F.when(kind == "number", surface).when(kind.isin("card", "ssn", "phone"), digits).when(kind == "email", cased).when(kind == "iban", spaced).when(kind.isin("ip", "key", "secret"), fake).otherwise(name)


def entities(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, kind, norm of the entities of each document, once each."""
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.explode(F.array_distinct(_matches(F.col(f"`{text_col}`")))).alias("x")).where("x.kind != 'number'")
    units = found.select("doc_id", F.explode(_units(F.col("x.m"), F.col("x.kind"))).alias("u"))
    return units.select("doc_id", "u.kind", "u.norm")


def raised(found: DataFrame, key: str) -> DataFrame:
    """kind, norm, attempt of the entities whose first surrogate collides."""
    # names of all kinds are told apart from each other
    space = F.when(F.col("kind").isin(*ENDINGS), "name").otherwise(F.col("kind")).alias("space")
    own = cut(found.select(space, "kind", "norm").distinct())
    real = own.select(F.col("space").alias("s"), F.col("norm").alias("real")).distinct()
    table = own.withColumn("attempt", F.lit(0))
    for _ in range(ROUNDS):
        table = table.select("space", "kind", "norm", "attempt", _fake(F.col("kind"), F.col("norm"), F.col("attempt"), key).alias("fake"))
        first = table.groupBy("space", "fake").agg(F.min(F.struct("attempt", "norm", "kind")).alias("first"), F.count(F.lit(1)).alias("n"))
        marked = table.join(first, ["space", "fake"]).join(real, (F.col("space") == F.col("s")) & (F.col("fake") == F.col("real")), "left")
        bad = F.col("real").isNotNull() | ((F.col("n") > 1) & ((F.col("norm") != F.col("first.norm")) | (F.col("kind") != F.col("first.kind"))))
        table = cut(marked.select("space", "kind", "norm", (F.col("attempt") + bad.cast("int")).alias("attempt"), bad.alias("bad")))
        if table.where("bad").limit(1).count() == 0:
            return table.where("attempt > 0").select("kind", "norm", "attempt")
    crowded = sorted(r["kind"] for r in table.where("bad").select("kind").distinct().collect())  # at most one row a kind
    raise RuntimeError(f"no distinct surrogates are left after {ROUNDS} attempts for entities of kind {', '.join(crowded)}")


def replace(docs: DataFrame, key: str = "tessera", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows with surrogates in the text; n_entities tells how many places changed."""
    found = cut(entities(docs, text_col, id_col))
    bumped = cut(raised(found, key))
    # columns by place, so that no name of the caller's meets one of these
    names = docs.columns
    place = {c: f"c{k}" for k, c in enumerate(names)}
    rows = docs.toDF(*place.values())
    text = F.col(place[text_col])
    attempts = F.lit(None).cast("map<string,int>")
    if bumped.limit(1).count():
        by_doc = found.join(bumped, ["kind", "norm"]).dropDuplicates(["doc_id", "kind", "norm"]).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0001", "kind", "norm"), "attempt"))).alias("__attempts"))
        rows = rows.join(by_doc.withColumnRenamed("doc_id", "__id"), F.col(place[id_col]).eqNullSafe(F.col("__id")), "left").drop("__id")
        attempts = F.col("__attempts")

    def surrogate(u: Column) -> Column:
        tried = F.coalesce(F.element_at(attempts, F.concat_ws("\u0001", u["kind"], u["norm"])), F.lit(0))
        return _let(_fake(u["kind"], u["norm"], tried, key), lambda fake: _dress(u["kind"], fake, u["surface"]))

    def written(x: Column) -> Column:
        """A match with its entities replaced (what stands before the first one stays), and its family names."""
        head = F.when(x["kind"] == "secret", F.regexp_extract(x["m"], _SECRET_HEAD, 0)).when(x["kind"] == "person", F.concat(F.element_at(F.split(x["m"], " "), 1), F.lit(" "))).otherwise(F.lit(""))
        made = F.transform(_units(x["m"], x["kind"]), lambda u: F.struct(u["kind"].alias("kind"), u["surface"].alias("surface"), surrogate(u).alias("now")))
        return _let(made, lambda us: F.struct(F.concat(head, F.array_join(F.transform(us, lambda u: u["now"]), " ")).alias("now"), F.filter(us, lambda u: u["kind"] == "family").alias("family")))

    rows = rows.withColumn("__m", _matches(text)).withColumn("__new", F.transform("__m", written))
    woven = F.array_join(F.zip_with(F.split(text, _ANY, -1), F.col("__new"), lambda a, b: F.concat(a, F.coalesce(b["now"], F.lit("")))), "")
    family = F.array_distinct(F.flatten(F.transform("__new", lambda x: x["family"])))
    bare = F.aggregate(family, woven, lambda acc, u: F.regexp_replace(acc, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), u["surface"], F.lit(r"(?![\p{L}\p{N}])")), u["now"]))
    own = {text_col: F.when(F.size("__m") > 0, bare).otherwise(text), "n_entities": F.coalesce(F.size(F.filter("__m", lambda x: x["kind"] != "number")), F.lit(0))}
    columns = [own.get(c, F.col(place[c])).alias(c) for c in names]
    return rows.select(*columns, *([own["n_entities"].alias("n_entities")] if "n_entities" not in names else []))
