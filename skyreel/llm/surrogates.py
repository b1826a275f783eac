"""Surrogates for personal data, in DataFrame operations only.

Entities are found by pattern. Every distinct entity gets one surrogate, derived from a secret key, that keeps its type
and form: letters become letters of the same case and script, digits digits, separators stay; addresses keep their
ending, numbers their first digit, card numbers their check digit, names their gender and script. Surrogates are checked
against each other and against the entities themselves until all differ, so different entities stay different, and one
entity has one surrogate wherever it is mentioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, prepared, unused

BROADCAST_ROWS = 1 << 18
"""The table of replacements is broadcast up to so many mentions (about 200 bytes each), else joined by a shuffle."""
TRIES = 64
LENGTHEN = 2
PHONE_TRIES = 8

# Titles that announce a name, by gender, and names to put in place of others, by script and gender.
TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"], "n": ["Dr", "Prof"]}
GIVEN = {
    "latin m": ["Albert", "Bruno", "Carl", "David", "Edgar", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Lukas", "Martin", "Nils", "Oscar", "Paul"],
    "latin f": ["Alice", "Berta", "Clara", "Diana", "Emma", "Flora", "Greta", "Hanna", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula"],
    "cyrillic m": ["Алексей", "Борис", "Виктор", "Глеб", "Дмитрий", "Егор", "Иван", "Кирилл"],
    "cyrillic f": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Ольга", "Юлия"],
    "greek m": ["Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σταύρος"],
    "greek f": ["Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"],
}
SYLLABLES = {"latin": ["ba", "den", "fol", "gar", "hem", "kin", "lor", "mas", "nov", "pel", "rud", "sen", "tor", "vin", "wal", "zim"], "cyrillic": ["ба", "ве", "гор", "дан", "кол", "лин", "мар", "нов", "пет", "род", "сен", "тар"], "greek": ["βα", "γρη", "δελ", "κασ", "λαμ", "μαρ", "νικ", "παπ", "ρου", "σταθ"]}

# Letters without case, and digits, of other scripts: first character and count of each unbroken range.
UNCASED = [
    ("\u05d0", 27), ("\u0620", 32), ("\u0641", 10), ("\u0671", 99), ("\u0904", 54), ("\u0985", 8), ("\u0993", 22), ("\u0a05", 6), ("\u0a13", 22), ("\u0a85", 9), ("\u0a93", 22),
    ("\u0b85", 6), ("\u0bae", 12), ("\u0c05", 8), ("\u0c12", 23), ("\u0c85", 8), ("\u0c92", 23), ("\u0d05", 8), ("\u0d12", 41), ("\u0d85", 18), ("\u0d9a", 24),
    ("\u0e01", 48), ("\u0ea7", 10), ("\u0e86", 5), ("\u0e8c", 24), ("\u0f49", 36), ("\u1000", 43), ("\u1200", 73), ("\u1780", 52), ("\u1820", 35),
    ("\u3041", 86), ("\u3105", 43), ("\u30a1", 90), ("\u3400", 6592), ("\u4e00", 20_976), ("\uac00", 11_172), ("\uff66", 10), ("\uff71", 45),
]
DIGITS = [(chr(x), 10) for x in (0x660, 0x6F0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xE50, 0xED0, 0xF20, 0x1040, 0x17E0, 0x1810, 0xFF10)]

NOT_TITLE = r"(?!(?:" + "|".join(t for titles in TITLES.values() for t in titles) + r")\b)"
"""A name is up to three capitalised words; a title begins the next one."""
PATTERNS = {
    "email": r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}",
    "secret": r"(?<![\p{L}\p{N}])(?=[0-9a-fA-F]*\d)(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{24,}(?![\p{L}\p{N}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "address": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\p{L}\p{N}])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\p{L}\p{N}.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<![\p{L}\p{N}])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "number": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "name": "(?:" + "|".join(rf"(?<=\b{t} )|(?<=\b{t}\. )" for titles in TITLES.values() for t in titles) + r")" + NOT_TITLE + r"\p{Lu}\p{Ll}+(?:[ -]" + NOT_TITLE + r"\p{Lu}\p{Ll}+){0,2}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
HINT = r"[@\d]|\b(?:" + "|".join(t for titles in TITLES.values() for t in titles) + r")\b"
"""What every text with an entity has."""


def kind_of(entity: Column) -> Column:
    out = F.lit("name")
    for name in ("number", "card", "phone", "address", "iban", "secret", "email"):
        whole = PATTERNS[name]
        out = F.when(F.regexp(entity, F.lit(f"^(?:{whole})$")), F.lit(name)).otherwise(out)
    return out


def canonical(kind: Column, entity: Column) -> Column:
    """What two mentions of one entity share: case, and separators of numbers, don't count."""
    bare = F.regexp_replace(entity, r"[ ().-]", "")
    return F.when(kind.isin("card", "phone", "iban"), F.upper(bare)).otherwise(F.when(kind == "secret", entity).otherwise(F.lower(entity)))


def _stream(key: str, kind: Column, entity: Column, attempt: Column) -> Column:
    """Keyed pseudo-random bytes as 256 hexadecimal digits."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, entity, attempt.cast("string"))
    return F.concat(*(F.sha2(F.concat(seed, F.lit(f"\x1f{k}")).cast("binary"), 256) for k in range(4)))


def _drawn(stream: Column, at: Column, below: Column | int) -> Column:
    """A number under ``below`` from place ``at`` of the stream."""
    piece = F.substring(F.concat(stream, stream), 1, 512)
    return F.pmod(F.conv(piece.substr(F.pmod(at * 7, F.lit(249)) + 1, F.lit(8)), 16, 10).cast("long"), F.lit(below) if isinstance(below, int) else below).cast("int")


def _spelled(entity: Column, stream: Column, first: int = 0, anywhere: bool = False) -> Column:
    """Every letter and digit redrawn in its class; other characters, and the ``first`` of them, stay.

    With ``anywhere``, letters without case and digits of the scripts listed above are redrawn in their range, and letters
    and numbers of no listed script become Latin letters and digits; only mail addresses can hold any.
    """
    ranges = [("a", "z"), ("A", "Z"), ("а", "я"), ("А", "Я"), ("α", "ω"), ("Α", "Ω"), ("0", "9")]
    others = F.array(*(F.struct(F.lit(low).alias("low"), F.lit(chr(ord(low) + n - 1)).alias("high"), F.lit(ord(low)).alias("code"), F.lit(n).alias("n")) for low, n in UNCASED + DIGITS))

    def one(c: Column, at: Column) -> Column:
        out = F.when(F.regexp(c, F.lit(r"\p{Ll}")), F.char(_drawn(stream, at, 26) + 97)).when(F.regexp(c, F.lit(r"\p{Lu}")), F.char(_drawn(stream, at, 26) + 65))
        drawn = F.transform(F.filter(others, lambda r: (c >= r["low"]) & (c <= r["high"])), lambda r: F.decode(F.unhex(F.lpad(F.hex(r["code"] + _drawn(stream, at, r["n"])), 4, "0")), "UTF-16BE"))
        plain = F.when(F.regexp(c, F.lit(r"\p{L}")), F.char(_drawn(stream, at, 26) + 97)).otherwise(F.char(_drawn(stream, at, 10) + 48))
        out = out.when((c > "9") & F.regexp(c, F.lit(r"[\p{L}\p{N}]")), F.coalesce(F.get(drawn, F.lit(0)), plain)).otherwise(c) if anywhere else out.otherwise(c)
        for low, high in ranges:
            letters = "".join(chr(x) for x in range(ord(low), ord(high) + 1) if chr(x) not in "ς΢")
            out = F.when((c >= low) & (c <= high), F.substring(F.lit(letters), 1, len(letters)).substr(_drawn(stream, at, len(letters)) + 1, F.lit(1))).otherwise(out)
        return F.when(at < first, c).otherwise(out)

    return F.array_join(F.transform(F.split(entity, ""), one), "")


def _luhn(number: Column) -> Column:
    """The check digit for a number without one."""
    digits = F.reverse(F.transform(F.split(number, ""), lambda c: c.cast("int")))
    doubled = F.transform(digits, lambda d, at: F.when(at % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.pmod(-F.aggregate(doubled, F.lit(0), lambda t, d: t + d), F.lit(10)).cast("string")


def _script(entity: Column) -> Column:
    return F.when(F.regexp(entity, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.regexp(entity, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")


def _picked(options: list[str], stream: Column, at: Column | int) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), _drawn(stream, F.lit(at) if isinstance(at, int) else at, len(options)) + 1)


def _family(entity: Column, stream: Column, more: Column) -> Column:
    out = None
    for script, parts in SYLLABLES.items():
        name = F.initcap(F.array_join(F.transform(F.sequence(F.lit(3), more + 6), lambda at: _picked(parts, stream, at)), ""))
        out = F.when(_script(entity) == script, name) if out is None else out.when(_script(entity) == script, name)
    return out


def _given(entity: Column, gender: Column, stream: Column) -> Column:
    out = F.lit(None).cast("string")
    for group, names in GIVEN.items():
        script, whose = group.split()
        out = F.when((_script(entity) == script) & (gender == whose), _picked(names, stream, 1)).otherwise(out)
    both = {s: GIVEN[f"{s} m"] + GIVEN[f"{s} f"] for s in SYLLABLES}
    for script, names in both.items():
        out = F.when(out.isNull() & (_script(entity) == script), _picked(names, stream, 2)).otherwise(out)
    return out


def surrogate(key: str, kind: Column, entity: Column, gender: Column, attempt: Column) -> Column:
    """A replacement of the canonical ``entity``, in its canonical form.

    Names and addresses of mail get a syllable or letter more every LENGTHEN attempts, phone numbers a digit more with each
    attempt after the first PHONE_TRIES: however many are taken, longer ones are free.
    """
    stream = _stream(key, kind, entity, attempt)
    more = F.floor(attempt / LENGTHEN).cast("int")
    lead = F.substring(entity, 1, 1)
    longer = F.repeat(F.when(F.regexp(lead, F.lit(r"\p{L}")), lead).otherwise("a"), more)
    digits = F.repeat(F.lit("0"), F.greatest(attempt - (PHONE_TRIES - 1), F.lit(0)))
    ending = F.regexp_extract(entity, r"\.[^.]*$", 0)
    local = F.regexp_replace(entity, r"\.[^.]*$", "")
    card = _spelled(entity, stream, 1)
    checked = F.substring(card, 1, 100).substr(F.lit(1), F.char_length(entity) - 1)
    valid = F.substring(entity, -1, 1) == _luhn(entity.substr(F.lit(1), F.char_length(entity) - 1))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: (_drawn(stream, k * 5, 254) + 1).cast("string")), ".")
    names = F.split(entity, "[ -]")
    full = F.when(F.size(names) > 1, F.concat(_given(entity, gender, stream), F.lit(" "), _family(entity, stream, more))).otherwise(_family(entity, stream, more))
    hexes = F.array_join(F.transform(F.split(entity, ""), lambda c, at: F.when(F.regexp(c, F.lit("[A-F]")), F.upper(stream.substr(F.pmod(at, F.lit(250)) + 1, F.lit(1)))).otherwise(stream.substr(F.pmod(at, F.lit(250)) + 1, F.lit(1)))), "")
    return (
        F.when(kind == "email", F.concat(_spelled(F.concat(longer, local), stream, anywhere=True), ending))
        .when(kind == "address", octets)
        .when(kind == "card", F.when(valid, F.concat(checked, _luhn(checked))).otherwise(card))
        .when(kind == "phone", _spelled(F.concat(entity, digits), stream, 2))
        .when(kind == "iban", _spelled(entity, stream, 2))
        .when(kind == "secret", hexes)
        .when(kind == "name", full)
        .otherwise(_spelled(entity, stream))
    )


def in_form(kind: Column, mention: Column, said: Column) -> Column:
    """The canonical surrogate ``said`` in the separators and case of one mention."""
    places = F.split(mention, "")
    # a digit or letter of the mention takes the next character of the surrogate
    laid = F.aggregate(
        places, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda state, c: F.when(F.regexp(c, F.lit(r"[ ().-]")), F.struct(F.concat(state["out"], c).alias("out"), state["at"].alias("at"))).otherwise(
            F.struct(F.concat(state["out"], said.substr(state["at"], F.lit(1))).alias("out"), (state["at"] + 1).alias("at"))
        ),
        lambda state: F.concat(state["out"], said.substr(state["at"], F.char_length(said))),  # what a longer surrogate has left
    )
    upper = F.upper(mention) == mention
    return F.when(kind.isin("card", "phone", "iban"), laid).when((kind == "email") & upper, F.upper(said)).otherwise(said)


def _settled(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, said): surrogates that differ from each other and from all entities, by redrawing those that don't."""
    taken = entities.select("kind", F.col("entity").alias("said"))
    fresh, done = checkpointed(entities), None
    for attempt in range(TRIES):
        drawn = fresh.select("kind", "entity", "gender", surrogate(key, F.col("kind"), F.col("entity"), F.col("gender"), F.lit(attempt)).alias("said"))
        drawn = checkpointed(drawn)
        alike = Window.partitionBy("kind", F.lower("said")).orderBy("entity")
        held = drawn.withColumn("turn", F.row_number().over(alike)).withColumn("low", F.lower("said"))
        held = held.join(taken.select("kind", F.lower("said").alias("low"), F.lit(True).alias("met")).distinct(), ["kind", "low"], "left")
        held = checkpointed(held.select("kind", "entity", "gender", "said", ((F.col("turn") == 1) & F.col("met").isNull()).alias("good")))
        won = held.where("good").select("kind", "entity", "said")
        done = won if done is None else done.unionByName(won)
        fresh = held.where(~F.col("good")).select("kind", "entity", "gender")
        if fresh.isEmpty():
            return done
        taken = taken.unionByName(won.select("kind", "said"))
    raise ValueError("personal data: no free surrogate is left for some entities of a form whose length is fixed")


def _gender(before: Column) -> Column:
    """By the title at the end of the text before a name."""
    out = F.lit("n")
    for gender, titles in TITLES.items():
        out = F.when(F.regexp(before, F.lit(r"\b(?:" + "|".join(titles) + r")\.? $")), gender).otherwise(out)
    return out


def replaced(documents: DataFrame, key: str) -> DataFrame:
    """``documents`` with every entity in ``text`` replaced, and the columns ``n_entities`` and ``kinds`` (distinct, sorted).

    Null and empty texts stay, with no entities. ``n_chars`` is set anew, where there is one. Rows with equal texts get
    equal texts. Existing columns named like the new ones are replaced; others go through.
    If all forms of an entity of fixed length are taken (after TRIES draws), the job ends with an error.
    """
    prepared(documents.sparkSession)
    swaps_, kinds_, mark_, length_ = unused(documents.columns, "__swaps", "__kinds", "__mark", "__length")
    texts = documents.where(F.col("text").isNotNull()).where(F.regexp("text", F.lit(HINT))).select("text", F.xxhash64("text").alias("mark"), F.char_length("text").alias("length"))
    parted = texts.select("mark", "length", F.regexp_extract_all("text", F.lit(ANY), F.lit(0)).alias("found"), F.split("text", ANY, -1).alias("gaps"))
    parted = parted.where(F.size("found") > 0)
    each = parted.select("mark", "length", F.posexplode(F.arrays_zip("found", F.slice("gaps", 1, F.size("found")).alias("before"))).alias("at", "m"))
    each = each.select("mark", "length", "at", F.col("m.found").alias("mention"), _gender(F.expr("right(m.before, 12)")).alias("gender"))
    each = each.withColumn("kind", kind_of(F.col("mention")))
    each = each.withColumn("entity", canonical(F.col("kind"), F.col("mention")))
    mentions = checkpointed(each.groupBy("mark", "length", "at").agg(F.first(F.struct("mention", "kind", "entity", "gender")).alias("m")).select("mark", "length", "at", "m.*"))
    entities = mentions.groupBy("kind", "entity").agg(F.min("gender").alias("gender"))
    said = _settled(entities, key)
    swaps = mentions.join(said, ["kind", "entity"]).select("mark", "length", "at", "kind", in_form(F.col("kind"), F.col("mention"), F.col("said")).alias("new"))
    lists = swaps.groupBy("mark", "length").agg(F.sort_array(F.collect_list(F.struct("at", "new"))).alias(swaps_), F.sort_array(F.collect_set("kind")).alias(kinds_))
    lists = lists.withColumnsRenamed({"mark": mark_, "length": length_})
    if mentions.count() <= BROADCAST_ROWS:
        lists = F.broadcast(lists)
    rows = documents.withColumn(mark_, F.xxhash64("text")).withColumn(length_, F.char_length("text")).join(lists, [mark_, length_], "left")
    gaps = F.split("text", ANY, -1)
    joined = F.concat(F.array_join(F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(swaps_)).alias("gap"), F.col(swaps_).alias("swap")), lambda z: F.concat(z["gap"], z["swap"]["new"])), ""), F.element_at(gaps, -1))
    out = rows.withColumn("text", F.when(F.col(swaps_).isNull(), F.col("text")).otherwise(joined))
    out = out.withColumn("n_entities", F.coalesce(F.size(swaps_), F.lit(0))).withColumn("kinds", F.coalesce(kinds_, F.array().cast("array<string>")))
    out = out.withColumn("n_entities", F.when(F.col(swaps_).isNull(), F.lit(0)).otherwise(F.size(swaps_)))
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col(swaps_).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(documents.schema["n_chars"].dataType)))
    return out.select(*[c for c in documents.columns if c not in ("n_entities", "kinds")], "n_entities", "kinds")
