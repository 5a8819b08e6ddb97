"""Replacement of personal data by keyed surrogates.

Entities (e-mail addresses, telephone, card, account and social security numbers, IP
addresses, access keys, passwords, tokens, names behind a form of address) are found by
patterns; the words of a name found so are replaced wherever else they stand in its text.
Each distinct entity gets one surrogate of the same type, drawn by a keyed hash: the
same entity has the same surrogate everywhere, however it is written. Letters stay
letters of the same case, digits stay digits, separators stay; a card number passes
the checksum if the original did; a name keeps its script, and a given name the gender
that the form of address tells. Surrogates that coincide with each other or with an
entity of the corpus are drawn again, after a few draws one character longer each time,
until all are distinct: the space to draw from grows faster than what may coincide.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sentspark.llm.scratch import Scratch, keep, scratch

KEY = "sentspark"
SAME_LENGTH = 4         # draws before surrogates grow

# Forms of address by the gender they tell.
FORMS = {
    "f": ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mme", "Mademoiselle", "Signora", "Госпожа", "Κυρία"),
    "m": ("Mr", "Mister", "Herr", "Herrn", "Señor", "Monsieur", "Signor", "Господин", "Κύριος"),
}
# Consonants, vowels, and the endings of female and male given names.
SCRIPTS = {
    "latin": (r"\p{IsLatin}", "bdfgklmnprstvz", "aeiou", "a", "o"),
    "cyrillic": (r"\p{IsCyrillic}", "бвгдзклмнпрстф", "аеиоу", "а", "о"),
    "greek": (r"\p{IsGreek}", "βγδζκλμνπρστφ", "αεηιου", "α", "ος"),
}
# Pattern of each type as (what stays before it, the entity). Where two
# could start at one place, the first listed wins.
_ADDRESS = "|".join(sorted((form for forms in FORMS.values() for form in forms), key=len, reverse=True))
_NAME = r"\p{Lu}\p{Ll}[\p{L}'’-]*"
PATTERNS = {
    "email": ("", r"[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"),
    "secret": ("", r"\b(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})\b"),
    "password": (r"""\b(?i:password|passwd|pwd)["']?\s?[=:]\s?["']?""", r"""[^\s"'<>]{3,}[^\s"'<>.,;:!?)]"""),
    "token": (r"""\b(?i:token|api_key|apikey|secret|access_key)["']?\s?[=:]\s?["']?""", r"[A-Za-z0-9_+/=-]{12,}"),
    "account": ("", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "card": ("", r"(?<![\d.-])(?:\d{4}[ -]?){3}\d{4}(?![\d-])|(?<![\d.-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\d-])"),
    "ssn": ("", r"(?<![\d.-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "phone": ("", r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
                  r"|(?<![\w.])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.])(?:1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-])"
                  r"|(?<![\w.])00\d{1,3}(?:[ .-]\d{2,4}){2,5}(?!\d)"),
    "ip6": ("", r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"),
    "ip": ("", r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\d|\.\d)"),
    "name": (rf"\b(?:{_ADDRESS})\.? ", rf"{_NAME}(?: {_NAME})?"),
}
ANY = "|".join(f"(?:{before}(?:{what}))" for before, what in PATTERNS.values())
# Necessary for any match and quick to look for.
HINT = rf"@|::|\d\d|\.\d|(?i:AKIA|ASIA|gh[pousr]_|sk-|passw|pwd|token|api_?key|secret|access_key)|\b(?:{_ADDRESS})\b"


def mentions(text: Column) -> Column:
    """All matches in the order of the text; none for NULL."""
    return F.when(F.rlike(text, F.lit(HINT)), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _segments(mention: Column) -> Column:
    """The mention as (type, key, raw) pieces; a piece without type stays as it is.
    The key is the entity as such, without its way of being written."""
    def piece(kind, key, raw):
        return F.struct(kind.cast("string").alias("type"), key.cast("string").alias("key"), raw.alias("raw"))

    none = F.lit(None)
    keys = {
        "email": F.lower, "password": lambda v: v, "secret": lambda v: v, "token": lambda v: v, "ip": lambda v: v,
        "card": lambda v: F.regexp_replace(v, r"\D", ""), "ssn": lambda v: F.regexp_replace(v, r"\D", ""),
        "phone": lambda v: F.regexp_replace(v, r"[^0-9+]", ""), "ip6": F.lower, "account": lambda v: F.replace(v, F.lit(" "), F.lit("")),
    }
    out = None
    for kind, (before, what) in PATTERNS.items():
        fits = F.rlike(mention, F.lit(rf"\A(?:{before}(?:{what}))\z"))
        head = F.regexp_extract(mention, rf"\A({before})", 1) if before else F.lit("")
        value = F.substring(mention, F.length(head) + F.lit(1), F.length(mention))
        if kind == "name":
            first, rest = F.substring_index(value, " ", 1), F.regexp_extract(value, r" (.*)\z", 1)
            gender = F.when(F.rlike(head, F.lit(rf"\A(?:{'|'.join(FORMS['f'])})\b")), "f").otherwise("m")
            script = F.when(F.rlike(value, F.lit(SCRIPTS["cyrillic"][0])), "cyrillic").when(
                F.rlike(value, F.lit(SCRIPTS["greek"][0])), "greek").otherwise("latin")
            surname = F.concat(F.lit("surname-"), script)
            parts = F.when(rest == "", F.array(piece(none, none, head), piece(surname, F.lower(first), first))).otherwise(F.array(
                piece(none, none, head), piece(F.concat(F.lit("given-"), gender, F.lit("-"), script), F.lower(first), first),
                piece(none, none, F.lit(" ")), piece(surname, F.lower(rest), rest)))
        else:
            parts = F.array(piece(none, none, head), piece(F.lit(kind), keys[kind](value), value))
        out = F.when(fits, parts) if out is None else out.when(fits, parts)
    return out.otherwise(F.array(piece(none, none, mention)))


def _byte(place: Column, key: str) -> Column:
    """Keyed pseudo-random byte number ``place`` (from 0) of the row's entity."""
    block = F.sha2(F.concat_ws("\u0001", F.lit(key), F.col("type"), F.col("key"), F.col("attempt"), F.floor(place / 32)).cast("binary"), 256)
    return F.conv(F.substring(block, (place % 32) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _of(alphabet: str, number: Column) -> Column:
    return F.substring(F.lit(alphabet), number % len(alphabet) + 1, F.lit(1))


_LOWER, _UPPER, _DIGITS, _HEX = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "0123456789abcdef"


def _like(value: Column, key: str, kept: Column | int = 0, hexadecimal: bool = False) -> Column:
    """Each character behind the first ``kept`` replaced by one of its class."""
    def draw(i: Column) -> Column:
        char, byte = F.substring(value, i, F.lit(1)), _byte(i, key)
        if hexadecimal:
            return _of(_HEX, byte)
        return (
            F.when(i <= F.lit(kept), char).when(F.rlike(char, F.lit("[0-9]")), _of(_DIGITS, byte))
            .when(F.rlike(char, F.lit(r"\p{Lu}")), _of(_UPPER, byte)).when(F.rlike(char, F.lit(r"\p{L}")), _of(_LOWER, byte)).otherwise(char)
        )

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), draw), "")


def _luhn(digits: Column) -> Column:
    """Checksum of a number, its last digit included, modulo 10."""
    places = F.sequence(F.lit(1), F.length(digits))
    each = F.transform(places, lambda i: F.substring(digits, -i, F.lit(1)).cast("int") * (2 - i % 2))
    return F.aggregate(each, F.lit(0), lambda acc, d: acc + F.when(d > 9, d - 9).otherwise(d)) % 10


def _modulo_97(value: Column) -> Column:
    """Remainder of an account number, its letters read as 10 to 35, modulo 97."""
    def add(acc, i):
        char = F.substring(value, i, F.lit(1))
        digit = F.when(F.rlike(char, F.lit("[0-9]")), char.cast("int")).otherwise(F.ascii(char) - 55)
        return (acc * F.when(digit > 9, 100).otherwise(10) + digit) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(value)), F.lit(0), add)


def _name(key: str, script: Column, given: Column, female: Column, more: Column) -> Column:
    """Syllables of the script, about as many as the name has and some ``more``; a given
    name ends by gender."""
    count = F.greatest(F.lit(2), F.least(F.lit(5), F.floor(F.length("key") / 2).cast("int"))) + more

    def word(consonants, vowels, feminine, masculine):
        body = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: F.concat(
            _of(consonants, _byte(i * 2, key)), _of(vowels, _byte(i * 2 + 1, key)))), "")
        last = _of(consonants, _byte(F.lit(0), key))
        return F.initcap(F.concat(body, last, F.when(~given, F.lit("")).when(female, feminine).otherwise(masculine)))

    out = word(*SCRIPTS["latin"][1:])
    for name in ("cyrillic", "greek"):
        out = F.when(script == name, word(*SCRIPTS[name][1:])).otherwise(out)
    return out


def surrogate(key: str) -> Column:
    """Surrogate of a row (type, key, attempt), in the form of the key; longer from the
    attempt SAME_LENGTH on."""
    kind, value = F.col("type"), F.col("key")
    more = F.greatest(F.lit(0), F.col("attempt") - SAME_LENGTH + 1)

    def longer(text: Column, char: str) -> Column:
        return F.concat(text, F.repeat(F.lit(char), more))

    local, domain = F.substring_index(value, "@", 1), F.substring_index(value, "@", -1)
    labels = F.split(domain, r"\.")
    # The last two labels give way to a domain reserved for examples.
    hosts = F.when(F.size(labels) > 2, F.concat(F.array_join(F.slice(labels, 1, F.size(labels) - 2), "."), F.lit("."))).otherwise(F.lit(""))
    address = _like(F.concat(longer(local, "x"), F.lit("@"), hosts), key)
    ending = F.element_at(labels, -1)
    email = F.concat(address, F.lit("example."), F.when(ending.isin("com", "net", "org"), ending).otherwise("com"))
    number = longer(value, "0")
    body = F.concat(F.substring(_like(number, key, kept=1), F.lit(1), F.length(number) - 1), F.lit("0"))
    check = (10 - _luhn(body)) % 10
    card = F.concat(F.substring(body, F.lit(1), F.length(body) - 1), F.when(_luhn(value) == 0, check).otherwise((check + 1) % 10).cast("string"))
    inner, country = _like(longer(F.substring(value, F.lit(5), F.length(value)), "0"), key), F.substring(value, 1, 2)
    account = F.concat(country, F.lpad((98 - _modulo_97(F.concat(inner, country, F.lit("00")))).cast("string"), 2, "0"), inner)
    groups = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda g: F.lower(F.lpad(F.hex(_byte(2 * g, key) * 256 + _byte(2 * g + 1, key)), 4, "0")))
    ip6 = F.concat(F.lit("2001:db8:"), F.array_join(groups, ":"))      # the range reserved for documentation
    octets = F.concat_ws(".", 1 + _byte(F.lit(1), key) % 223, _byte(F.lit(2), key), _byte(F.lit(3), key), 1 + _byte(F.lit(4), key) % 254)
    script, given, female = F.substring_index(kind, "-", -1), F.startswith(kind, F.lit("given")), F.startswith(kind, F.lit("given-f"))
    coded = F.when(F.rlike(value, F.lit(r"\A[0-9a-f]+\z")), _like(longer(value, "0"), key, hexadecimal=True)).otherwise(_like(longer(value, "0"), key))
    return (
        F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", F.when(more > 4, ip6).otherwise(octets)).when(kind == "ip6", ip6)
        .when(kind == "account", account).when(kind == "ssn", _like(number, key))
        .when(kind == "phone", _like(number, key, kept=F.when(F.startswith(value, F.lit("+")), 2).otherwise(0)))
        .when(kind == "secret", _like(longer(value, "0"), key, kept=F.when(F.startswith(value, F.lit("sk-")), 3).otherwise(4)))
        .when(kind.isin("password", "token"), coded).otherwise(_name(key, script, given, female, more))
    )


def _written(kind: Column, raw: Column, new: Column) -> Column:
    """The surrogate written the way the mention is: numbers with its separators,
    addresses and names in its case."""
    def filled(place: str, chars: Column) -> Column:
        """``chars`` at the places of ``raw`` that fit the class, the rest behind them."""
        def at(i: Column) -> Column:
            char = F.substring(raw, i, F.lit(1))
            nth = F.length(F.regexp_replace(F.substring(raw, F.lit(1), i), f"[^{place}]", ""))
            return F.when(F.rlike(char, F.lit(f"[{place}]")), F.substring(chars, nth, F.lit(1))).otherwise(char)

        used = F.length(F.regexp_replace(raw, f"[^{place}]", ""))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(raw)), at), ""), F.substring(chars, used + 1, F.length(chars)))

    shouted = (F.upper(raw) == raw) & (F.lower(raw) != raw)
    return (
        F.when(kind.isNull(), raw).when(kind.isin("card", "phone", "ssn"), filled("0-9", F.regexp_replace(new, r"\D", "")))
        .when(kind == "account", filled("A-Z0-9", new)).when(kind.isin("password", "token", "secret", "ip", "ip6"), new).when(shouted, F.upper(new)).otherwise(new)
    )


def draw_surrogates(entities: DataFrame, tmp: Scratch, key: str = KEY) -> DataFrame:
    """type, key and surrogate of each distinct entity; surrogates of one type are
    distinct and none is an entity. Each round draws again what coincides; who was
    settled in an earlier round keeps its surrogate."""
    known = tmp.table(entities.select("type", "key").distinct())
    drawn = known.withColumn("attempt", F.lit(0))
    while True:
        drawn = tmp.table(drawn.withColumn("surrogate", surrogate(key)))
        turn = F.row_number().over(Window.partitionBy("type", "surrogate").orderBy("attempt", "key"))
        taken = known.select("type", F.col("key").alias("surrogate"), F.lit(True).alias("real"))
        ranked = drawn.withColumn("turn", turn).join(taken, ["type", "surrogate"], "left")
        clash = (F.col("turn") > 1) | F.col("real").isNotNull()
        if ranked.where(clash).isEmpty():
            return drawn.select("type", "key", "surrogate")
        drawn = ranked.select("type", "key", (F.col("attempt") + clash.cast("int")).alias("attempt"))


_NAME_CHAR = r"[\p{L}\p{M}-]"
_NAME_EDGES = rf"(?<={_NAME_CHAR})(?!{_NAME_CHAR})|(?<!{_NAME_CHAR})(?={_NAME_CHAR})"


def _renamed(text: Column, names: Column) -> Column:
    """``text`` with its words that equal a name (raw) replaced, all at once."""
    def word(w: Column) -> Column:
        return F.coalesce(F.get(F.filter(names, lambda n: n["raw"] == w), F.lit(0))["new"], w)

    return F.when(F.size(names) == 0, text).otherwise(F.array_join(F.transform(F.split(text, _NAME_EDGES, -1), word), ""))


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced; all other columns and the order
    of the text's other parts stay.

    Texts without a mention pass through untouched and unshuffled. Of the others the
    mentions are joined to the surrogates, and come back to their text by the number
    of the row. NULL or empty text stays; NULL in other columns too; repeated rows get
    equal texts. No rows in, no rows out. Extra columns may have any name. Texts are read
    whole, however long. The words of a name behind a form of address are replaced
    wherever else they stand in its text, written alike.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("text").cast("string").alias("body"))
    packed = packed.withColumn("found", mentions(F.col("body")))
    clean = packed.where(F.size("found") == 0).select("row.*")
    with scratch(docs.sparkSession, "surrogates") as tmp:
        hits = tmp.table(packed.where(F.size("found") > 0).withColumn("number", F.monotonically_increasing_id()))
        # The mentions are a small file; what is done with each of them is not.
        pieces = tmp.table(
            hits.select("number", "found").repartition("number").select("number", F.posexplode("found").alias("place", "mention"))
            .select("number", "place", _segments(F.col("mention")).alias("segments"))
            .select("number", "place", F.size("segments").alias("parts"), F.posexplode("segments").alias("part", "s"))
            .select("number", "place", "part", (F.col("part") + 1 == F.col("parts")).alias("last"), "s.type", "s.key", "s.raw"))
        drawn = draw_surrogates(pieces.where("type IS NOT NULL"), tmp, key)
        written = (
            pieces.join(drawn, ["type", "key"], "left")
            .select("number", "place", "part", "last", "type", "raw", _written(F.col("type"), F.col("raw"), F.col("surrogate")).alias("new"))
            .groupBy("number").agg(
                F.array_sort(F.collect_list(F.struct("place", "part", "last", "new"))).alias("news"),
                F.array_sort(F.collect_set(F.when(F.rlike("type", F.lit("^(given|surname)-")), F.struct("raw", "new")))).alias("names"))
        )
        between = F.transform(F.split("body", ANY, -1), lambda part: _renamed(part, F.col("names")))
        text = F.concat(
            between[0],
            F.array_join(F.transform("news", lambda n: F.concat(
                n["new"], F.when(n["last"], F.element_at(between, n["place"] + 2)).otherwise(F.lit("")))), ""),
        )
        changed = keep(
            hits.join(written, "number").withColumn("body", text)
            .select(*[F.col("body").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names]))
    return clean.unionByName(changed)
