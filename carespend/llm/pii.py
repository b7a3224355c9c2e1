"""Surrogates for personal data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carespend.llm.joins import sized
from carespend.sources.io import stage

# Titles by the gender they tell, and what each kind of entity looks like.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Signor", "Господин", "Κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Signora", "Госпожа", "Κυρία"],
    "n": ["Dr", "Prof"],
}
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?[0-9])",
    # at least one digit and either eight groups or a double colon; addresses that end in it are left out
    "ip6": r"(?<![\w:.])(?=[0-9A-Fa-f]{0,4}:)(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}|(?:[0-9A-Fa-f]{1,4}:){1,6}:(?:[0-9A-Fa-f]{1,4}:){0,5}|::(?:[0-9A-Fa-f]{1,4}:){0,6})[0-9A-Fa-f]{1,4}(?![\w:])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,2}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
    r"|(?<![0-9.-])[2-9][0-9]{2}(?:-[0-9]{3}-|\.[0-9]{3}\.| [0-9]{3} )[0-9]{4}(?![0-9-]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:-[0-9]{4}){3}|[0-9]{4}(?: [0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "name": r"(?<!\p{L})(?:" + "|".join(t for group in TITLES.values() for t in group) + r")\.? \p{Lu}\p{L}+(?:[ -]\p{Lu}\p{L}+){0,2}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has a part of, found faster.
LIKELY = r"[0-9@]|(?:" + "|".join(t for group in TITLES.values() for t in group) + r")\.? \p{Lu}"
# Syllables that made-up names consist of, by script, and their endings by gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke la le li ma me mi na ne no pa po ra re ro sa se ta te va vi".split(),
    "cyrillic": "ба бе бо да де до га го ка ке ла ле ли ма ме ми на не но па по ра ре ро са се та те ва ви".split(),
    "greek": "βα βε βο δα δε δο γα γο κα κε λα λε λι μα με μι να νε νο πα πο ρα ρε ρο σα σε τα τε φα φι".split(),
}
ENDINGS = {
    "latin": {"m": "n", "f": "nia", "n": "ri", "family": "ck"},
    "cyrillic": {"m": "н", "f": "ния", "n": "ри", "family": "ко"},
    "greek": {"m": "ς", "f": "νια", "n": "ρι", "family": "ίδη"},
}
#: From this attempt on a format with too few values is widened, and a surrogate may be the original of another entity.
WIDENED = 8


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def found_parts(docs: DataFrame) -> DataFrame:
    """``doc_id, row, at, word, kind, canonical, part``: the texts that hold entities, cut into what is an entity and what is not.

    ``at`` counts matches; a title and name is cut into words, so that a family name alone and
    with a given name are the same entity. ``kind`` is null for all other parts.
    """
    matches = F.regexp_extract_all("text", F.lit(ANY), F.lit(0))
    cut = docs.select("doc_id", "row", F.split("text", ANY, -1).alias("between"), matches.alias("matches"))
    kind = F.lit("name")
    for name in reversed([k for k in PATTERNS if k != "name"]):
        pattern = PATTERNS[name]
        kind_of = lambda m, rest=kind, p=pattern, n=name: F.when(m.rlike(f"^(?:{p})$"), F.lit(n)).otherwise(rest if isinstance(rest, Column) else rest(m))
        kind = kind_of
    entity = cut.select("doc_id", "row", F.posexplode_outer("matches").alias("at", "m")).where("m IS NOT NULL").withColumn("kind", kind(F.col("m")))
    plain = cut.select("doc_id", "row", F.posexplode_outer("between").alias("at", "part")).select(
        "doc_id", "row", "at", F.lit(-1).alias("word"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("canonical"), "part"
    )
    canonical = F.when(F.col("kind") == "email", F.lower("m")).when(F.col("kind") == "ip", F.col("m")).when(F.col("kind") == "ip6", F.lower("m")).otherwise(_digits(F.col("m")))
    single = entity.where("kind <> 'name'").select("doc_id", "row", "at", F.lit(0).alias("word"), "kind", canonical.alias("canonical"), F.col("m").alias("part"))

    words = F.regexp_extract_all("m", F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    named = entity.where("kind = 'name'").withColumn("words", words)
    title = F.element_at("words", 1)
    gender = F.when(title.isin(TITLES["m"]), "m").when(title.isin(TITLES["f"]), "f").otherwise("n")
    # a person that a text also names with a title that tells the gender has that one after Dr or Prof too
    person = Window.partitionBy("doc_id", "row", F.lower(F.array_join(F.filter(F.slice("words", 2, 100), lambda w: w.rlike(r"^\p{L}")), " ")))
    told = F.when(gender != "n", gender)
    gender = F.when((gender == "n") & (F.min(told).over(person) == F.max(told).over(person)), F.min(told).over(person)).otherwise(gender)
    named = named.select("doc_id", "row", "at", gender.alias("gender"), F.size("words").alias("n"), F.posexplode_outer("words").alias("word", "part"))
    is_word = (F.col("word") > 0) & F.col("part").rlike(r"^\p{L}")
    role = F.when(F.col("word") == F.col("n") - 1, F.lit("family")).otherwise(F.col("gender"))
    script = F.when(F.col("part").rlike(r"\p{IsCyrillic}"), "cyrillic").when(F.col("part").rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    named = named.select(
        "doc_id", "row", "at", "word", F.when(is_word, F.concat_ws("-", F.lit("name"), script, role)).alias("kind"), F.when(is_word, F.lower("part")).alias("canonical"), "part"
    )
    return plain.unionByName(single).unionByName(named)


def with_mentions(parts: DataFrame) -> DataFrame:
    """The parts with what is not an entity cut further: capitalised words that are part of a name found in the same text.

    Such a word is the same entity as in the name, the family name if it is both. The new
    parts have a negative ``word``, so that they stay before the entity of the same ``at``.
    """
    keys = ["doc_id", "row"]
    found = parts.where(F.col("kind").startswith("name")).select(*keys, "canonical", "kind").distinct()
    # least: family, m, f, n
    rank = F.struct(~F.col("kind").endswith("family"), ~F.col("kind").endswith("-m"), "kind")
    found = found.groupBy(*keys, "canonical").agg(F.min(rank)["kind"].alias("kind"))
    found = sized(found.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("canonical").alias("_name"), F.col("kind").alias("_kind")), "names")
    plain = parts.where("kind IS NULL AND word = -1")
    here = (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.col("row") == F.col("_row"))
    holders = found.select("_id", "_row").distinct()
    cut = plain.join(holders, here, "left_semi").select(*keys, "at", F.posexplode(F.regexp_extract_all("part", F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))).alias("word", "part"))
    cut = cut.join(found, here & (F.lower("part") == F.col("_name")) & F.col("part").rlike(r"^\p{Lu}"), "left")
    name = F.when(F.col("_kind").isNotNull(), F.col("_name"))
    cut = cut.select(*keys, "at", (F.col("word") - F.lit(1 << 30)).alias("word"), F.col("_kind").alias("kind"), name.alias("canonical"), "part")
    rest = parts.where("kind IS NOT NULL OR word <> -1").unionByName(plain.join(holders, here, "left_anti"))
    return rest.unionByName(cut)


def _luhn(digits: Column) -> Column:
    """Sum of the digits by Luhn's rule; a number is valid if it is a multiple of 10."""
    number = F.reverse(F.filter(F.split(digits, ""), lambda d: d != ""))
    weighed = F.transform(number, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(weighed, F.lit(0), lambda a, d: a + d)


def surrogate(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """A keyed replacement of the same kind and format; each attempt gives another."""
    seed = F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string"))
    stream = F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("|more")), 256))
    drawn = lambda i: F.conv(F.substr(stream, 4 * (i % 32) + 1, F.lit(4)), 16, 10).cast("int")
    letter = lambda i: F.char(97 + drawn(i) % 26)
    digit = lambda i: (drawn(i) % 10).cast("string")
    chars = F.filter(F.split(canonical, ""), lambda c: c != "")
    join = lambda parts: F.array_join(parts, "")
    changed = lambda c, i: F.when(c.rlike("[a-z]"), letter(i)).when(c.rlike("[0-9]"), digit(i)).otherwise(c)
    widened = F.greatest(F.lit(0), attempt - WIDENED + 1).cast("int")

    top = F.concat(F.lit("."), F.substring_index(canonical, ".", -1))
    upto = F.length(canonical) - F.length(top)
    more = join(F.transform(F.when(widened > 0, F.sequence(F.lit(1), widened)).otherwise(F.array().cast("array<int>")), lambda i: letter(i + 7)))
    email = F.concat(more, join(F.transform(F.slice(chars, F.lit(1), upto), changed)), top)

    octet = lambda x, i: F.when(
        (attempt >= WIDENED) | (F.length(x) == 0), 1 + drawn(i) % 254
    ).otherwise(F.when(F.length(x) == 1, 1 + drawn(i) % 9).when(F.length(x) == 2, 10 + drawn(i) % 90).otherwise(100 + drawn(i) % 155))
    ip = F.array_join(F.transform(F.split(canonical, r"\."), lambda x, i: octet(x, i).cast("string")), ".")

    hexed = lambda c, i: F.when(c.rlike("[a-f]"), F.char(97 + drawn(i) % 6)).when(c.rlike("[0-9]"), digit(i)).otherwise(c)
    ip6 = join(F.transform(chars, hexed))
    last = F.concat(digit(F.lit(28)), *(F.lower(F.hex((drawn(F.lit(i)) % 16).cast("long"))) for i in (29, 30, 31)))
    ip6 = F.when(attempt >= WIDENED, F.concat(F.regexp_replace(ip6, "[0-9a-f]{1,4}$", ""), last)).otherwise(ip6)

    phone = join(F.transform(chars, lambda c, i: F.when(i == 0, c).when(i == 1, (2 + drawn(i) % 8).cast("string")).otherwise(digit(i))))
    ssn = join(F.transform(chars, lambda c, i: F.when(i == 0, (1 + drawn(i) % 8).cast("string")).otherwise(digit(i))))
    card = join(F.transform(chars, lambda c, i: F.when(i == 0, c).otherwise(digit(i))))
    body = F.substr(card, F.lit(1), F.length(card) - 1)
    checked = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string"))
    card = F.when(_luhn(canonical) % 10 == 0, checked).otherwise(card)

    picked = lambda pool, n: lambda x: F.get(pool, x % n)
    name = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        pool = F.array(*map(F.lit, syllables))
        count = 3 + F.floor(attempt / 2).cast("int")
        for role, ending in ENDINGS[script].items():
            made = join(F.transform(F.transform(F.sequence(F.lit(1), count), drawn), picked(pool, len(syllables))))
            name = F.when(kind == f"name-{script}-{role}", F.concat(made, F.lit(ending))).otherwise(name)
    return (
        F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "ip6", ip6).when(kind == "phone", phone).when(kind == "ssn", ssn).when(kind == "card", card).otherwise(name)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``kind, canonical, surrogate`` for distinct entities: no two of a kind share one, and none is itself an original.

    Of entities that draw the same value the least keeps it; the others draw again.
    """
    taken = None
    pending = stage(entities.withColumn("attempt", F.lit(0)), "entities")
    originals = entities.select("kind", F.col("canonical").alias("surrogate"))
    while not pending.isEmpty():
        drawn = pending.withColumn("surrogate", surrogate(F.col("kind"), F.col("canonical"), F.col("attempt"), key))
        drawn = stage(drawn, "drawn")
        free = drawn.join(originals, ["kind", "surrogate"], "left_anti").unionByName(drawn.where(F.col("attempt") >= WIDENED).join(originals, ["kind", "surrogate"], "left_semi"))
        if taken is not None:
            free = free.join(taken, ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical"))
        won = stage(won.select("kind", "canonical", "surrogate"), "won")
        taken = won if taken is None else stage(taken.unionByName(won), "surrogates")
        left = drawn.join(won, ["kind", "canonical"], "left_anti")
        pending = stage(left.select("kind", "canonical", (F.col("attempt") + 1).alias("attempt")), "pending")
    return taken if taken is not None else entities.withColumn("surrogate", F.col("canonical"))


def written(kind: Column, part: Column, value: Column) -> Column:
    """The surrogate in the writing of the part it replaces: its separators, capitals and spacing."""
    chars = F.filter(F.split(part, ""), lambda c: c != "")
    before = lambda i: F.length(_digits(F.substr(part, F.lit(1), i)))
    digits = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike("[0-9]"), F.substr(value, before(i) + 1, F.lit(1))).otherwise(c)), "")
    ahead = F.length(value) - F.length(part)
    cased = F.array_join(
        F.transform(
            F.filter(F.split(value, ""), lambda c: c != ""),
            lambda c, i: F.when(F.substr(part, F.greatest(i - ahead + 1, F.lit(1)), F.lit(1)).rlike("[A-Z]") & (i >= ahead), F.upper(c)).otherwise(c),
        ),
        "",
    )
    proper = F.when(F.upper(part) == part, F.upper(value)).otherwise(F.concat(F.upper(F.substr(value, F.lit(1), F.lit(1))), F.substr(value, F.lit(2))))
    return F.when(kind == "email", cased).when(kind.isin("ip", "ip6"), value).when(kind.startswith("name"), proper).otherwise(digits)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts in which personal data gave way to surrogates: mail and IP addresses, phone, card and social security numbers, titled names.

    Words of a titled name are replaced wherever the same text has them with a capital, with
    or without a title. Names that a text never gives a title are not found, nor are IPv6
    addresses that end in a double colon; two writings of an IPv6 address are two entities.

    Returns a row per row of ``docs``: ``doc_id, text, n_entities``, each untitled word of a name being counted. The same entity has the
    same surrogate everywhere, different ones have different ones, all depend on ``key``.
    Numbers keep length, separators and a valid check digit; names keep gender and script.

    Null text gives an empty one. Rows that repeat an id are handled each. No rows give no
    rows; other columns are ignored, whatever their names.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("row", F.xxhash64("text"))
    some = F.col("text").rlike(LIKELY) & F.col("text").rlike(ANY)
    parts = stage(with_mentions(stage(found_parts(own.where(some)), "entity-parts")), "entity-mentions")
    tokens = parts.where("kind IS NOT NULL")
    table = sized(surrogates(tokens.select("kind", "canonical").distinct(), key), "surrogate-table")
    changed = tokens.join(table, ["kind", "canonical"]).withColumn("part", written(F.col("kind"), F.col("part"), F.col("surrogate")))
    columns = ["doc_id", "row", "at", "word", "part"]
    every = parts.where("kind IS NULL").select(*columns, F.lit(0).alias("new")).unionByName(changed.select(*columns, F.lit(1).alias("new")))
    # a set, as rows that repeat an id and a text have the same parts
    whole = every.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set(F.struct("at", "word", "part", "new"))).alias("parts"))
    copies = own.where(some).groupBy("doc_id", "row").agg(F.count(F.lit(1)).cast("int").alias("copies")).withColumnsRenamed({"doc_id": "id", "row": "r"})
    joined = whole.join(copies, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("row") == F.col("r")))
    joined = joined.select("doc_id", "parts", F.explode(F.array_repeat(F.lit(0), F.col("copies"))))
    matches = F.size(F.array_distinct(F.transform(F.filter("parts", lambda p: p["new"] == 1), lambda p: F.struct(p["at"], F.least(p["word"], F.lit(0))))))
    done = joined.select("doc_id", F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("text"), matches.cast("long").alias("n_entities"))
    return done.unionByName(own.where(~some).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities")))
