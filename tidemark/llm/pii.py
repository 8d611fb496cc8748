"""PII surrogates, by DataFrame functions alone.

Detected entities give way to keyed replacements of their own kind: an e-mail address becomes
another one, digits become digits in the same layout, letters become letters of the same case and
script, a given name another one of its gender. An entity is known by its canonical form (the
digits of a phone or card number, an address in lower case, a given and a family name by
themselves), and each form has one surrogate everywhere, written as the mention is written
(coreference). Candidates that meet another surrogate or a real entity are drawn anew, and where
a layout has too few values for its entities, longer ones are drawn (distinctness).

The table of distinct forms is built from partial aggregates, so a frequent entity is one row
there, and the most frequent ones are joined apart. The texts are searched once.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, join_hot, let, text_or_empty

MALE = "Mr|Herrn?|Monsieur|Señor|Sr"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta"
TITLES = f"{FEMALE}|{MALE}|Dr|Prof"
#: Given names by gender, all in Latin script: those that stand in for others, and more that are known.
GIVEN = {
    "male": "Adam Aldo Boris Carl Dario Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nils Oscar Paul Ramon Simon Theo".split(),
    "female": "Ada Alma Bella Clara Dora Elena Flora Greta Hanna Irma Julia Klara Lena Marta Nora Olga Paula Rosa Sofia Tilda".split(),
}
KNOWN = {
    "male": "Alexander Andrew Antonio Charles Christopher Daniel David Edward Fernando François George Hans Henry Jack James Javier Jean Johannes John José Joseph Juan Jürgen Kevin Klaus Louis Luis Manuel Martin Matthew Michael Miguel Nicolas Pablo Pedro Peter Philippe Pierre Richard Robert Stefan Thomas William Wolfgang".split(),
    "female": "Alice Ana Anna Anne Barbara Carmen Catherine Charlotte Christine Claire Dorothy Elizabeth Emily Emma Eva Françoise Grace Ingrid Isabel Jane Jennifer Jessica Karen Katharina Laura Linda Lucía Margaret María Maria Marie Mary Monika Nancy Patricia Pilar Sabine Sarah Susan Teresa Ursula".split(),
}
ALL_GIVEN = {gender: [*GIVEN[gender], *KNOWN[gender]] for gender in GIVEN}
WORD = r"(?:\p{Lu}\p{L}+|\p{Lo}+)(?:-(?:\p{Lu}\p{L}+|\p{Lo}+))?"
TITLE_OR_GIVEN = rf"(?<!\p{{L}})(?=[A-Z])(?:{TITLES}|{'|'.join(ALL_GIVEN['male'] + ALL_GIVEN['female'])})"
HEX = "[0-9A-Fa-f]{1,4}"
OCTET = "(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}-]*[\p{L}\p{N}])?"
#: Patterns by kind, in order of precedence.
PATTERNS = {
    "email": rf"(?<![\p{{L}}\p{{N}}._%+-])[\p{{L}}\p{{N}}._%+-]++@{LABEL}(?:\.{LABEL})+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?[0-9])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:(?:{HEX}:){{7}}{HEX}|(?:{HEX}:){{1,6}}(?::{HEX}){{1,6}}|(?:{HEX}:){{1,7}}:|::(?:{HEX}:){{0,6}}{HEX})(?![0-9A-Za-z:])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "card": r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])",
    "name": rf"{TITLE_OR_GIVEN}(?:(?<={'|'.join(f'(?<!\\p{{L}}){t}' for t in TITLES.split('|'))})\.? {WORD}(?: {WORD})?| {WORD})",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without a match of this has no entity; it costs far less to look for.
HINT = rf"[0-9@]|{TITLE_OR_GIVEN}\.? [\p{{Lu}}\p{{Lo}}]"
#: Alphabets within which letters are replaced: vowels by vowels, others by others.
ALPHABETS = ("aeiou", "bcdfghjklmnpqrstvwxyz", "äöüáéíóúàèìòùâêîôû", "ñçß", "αεηιουω", "βγδζθκλμνξπρστφχψ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ")
#: For the other letters of a script, and at the end for those of any other script.
OTHERS = (
    (r"\p{IsLatin}", "åæøœšžčćďěňřťůýłńśźżąęőűāēģīķļņūășțğşđðþėįųạảậếệịọốộụữ"),
    (r"\p{IsGreek}", "άέήίόύώϊϋ"),
    (r"\p{IsCyrillic}", "ёђѓєѕіїјљњћќўџґқңүұһәө"),
    (r"\p{IsArmenian}", "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ"),
    (r"\p{IsGeorgian}", "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ"),
    (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"\p{IsArabic}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    (r"\p{IsDevanagari}", "अआइईउऊएऐओऔकखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह"),
    (r"\p{IsHangul}", "가나다라마바사아자차카타파하고노도로모보소오조구누두루무부수우주"),
    (r"\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろ"),
    (r"\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロ"),
    (r"\p{IsHan}", "安白成德方光国海华建江金军兰丽林龙美明宁平青庆荣山生胜水天文武祥新兴秀雪英永玉云志中"),
    (r"\p{L}", "bcdfghjklmnpqrstvwxyz"),
)
#: After so many draws without a free candidate, a form grows by one character more.
PATIENCE = 30


def entities(text: Column) -> Column:
    """The entities of a text in order: leftmost matches, of kinds that start at one place the first."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))).otherwise(F.array().cast("array<string>"))


def kind_of(value: Column) -> Column:
    return reduce(lambda rest, kind: F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), kind).otherwise(rest), reversed(PATTERNS), F.lit("name"))


def characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def alphabet_of(c: Column) -> Column:
    """The letters or digits within which a character is replaced; null for a character that stays."""
    lower = F.lower(c)
    known = F.when(c.between("0", "9"), F.lit("0123456789"))
    for letters in ALPHABETS:
        known = known.when(F.contains(F.lit(letters), lower), F.lit(letters))
    for script, letters in OTHERS:
        known = known.when(c.rlike(f"^{script}$") & c.rlike(r"^\p{L}$"), F.lit(letters))
    return known


def _draw(seed: Column, place: Column, choices: int | Column) -> Column:
    """A keyed number from 0 to ``choices`` - 1 for a place of a string: four hex digits of a digest."""
    block = F.sha2(F.concat_ws("|", seed, F.floor(place / 16).cast("string")), 256)
    return F.conv(F.substring(block, (place % 16) * 4 + 1, F.lit(4)), 16, 10).cast("int") % choices


def _replaced(value: Column, seed: Column) -> Column:
    """Each digit and letter of a canonical form replaced by one of its alphabet, anything else kept."""

    def one(c: Column, i: Column) -> Column:
        new = lambda letters: F.substring(letters, _draw(seed, i, F.length(letters)) + 1, F.lit(1))
        return let(alphabet_of(c), lambda letters: F.when(letters.isNull(), c).otherwise(new(letters)))

    return F.array_join(F.transform(characters(value), one), "")


def like(mention: Column, new: Column) -> Column:
    """``new`` with capitals where ``mention`` has them."""

    def one(old: Column, c: Column) -> Column:
        return F.when(c.isNull(), "").when(old.rlike(r"^[\p{Lu}\p{Lt}]$") & (F.length(F.upper(c)) == 1), F.upper(c)).otherwise(c)

    return F.array_join(F.zip_with(characters(mention), characters(new), one), "")


def luhn(digits: Column) -> Column:
    """The checksum of a card number's digits; 0 for a valid one."""
    twice = lambda d: d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
    doubled = F.transform(characters(F.reverse(digits)), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(twice(d)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10


def _card(value: Column, drawn: Column) -> Column:
    """A drawn number; if the original passes its checksum, with the last digit that makes it pass too."""
    body = F.substring(drawn, F.lit(1), F.length(drawn) - 1)
    last = (10 - luhn(F.concat(body, F.lit("0")))) % 10
    return F.when(luhn(value) == 0, F.concat(body, last.cast("string"))).otherwise(drawn)


def name_parts(value: Column) -> tuple[Column, Column, Column]:
    """Form of address with its space, given name, family name; empty where there is none.

    One name after a form of address is a family name.
    """
    title = F.regexp_extract(value, rf"^((?:{TITLES})\.? )", 1)
    rest = F.substring(value, F.length(title) + 1, F.length(value))
    given = F.when(F.contains(rest, F.lit(" ")), F.substring_index(rest, " ", 1)).otherwise("")
    return title, given, F.substring_index(rest, " ", -1)


def gender_of(title: Column, given: Column) -> Column:
    """By the form of address, or else by a known given name; empty if neither tells."""
    by_name = F.when(given.isin(ALL_GIVEN["female"]), "female").when(given.isin(ALL_GIVEN["male"]), "male").otherwise("")
    return F.when(title.rlike(rf"^(?:{FEMALE})\.? $"), "female").when(title.rlike(rf"^(?:{MALE})\.? $"), "male").otherwise(by_name)


def _country(value: Column) -> Column:
    return F.regexp_extract(value, r"^(\+[0-9]{1,3}(?=[ .(-])|)", 1)


def forms(kind: Column, value: Column) -> Column:
    """The canonical forms of a mention as an array of (kind, form): one, or family and given name."""
    form = lambda kind, value: F.struct(kind.alias("kind"), value.alias("form"))
    title, given, family = name_parts(value)
    names = F.array(form(F.lit("family"), F.lower(family)), F.when(given != "", form(F.concat_ws(" ", F.lit("given"), gender_of(title, given)), F.lower(given))))
    digits = lambda c: F.regexp_replace(c, "[^0-9]", "")
    national = F.substring(value, F.length(_country(value)) + 1, F.length(value))
    plain = F.when(kind == "phone", digits(national)).when(kind.isin("ssn", "card"), digits(value)).when(kind == "iban", F.regexp_replace(value, " ", "")).otherwise(F.lower(value))
    return F.array_compact(F.when(kind == "name", names).otherwise(F.array(form(kind, plain))))


def written(kind: Column, value: Column, new: Column, given: Column) -> Column:
    """A mention's surrogate, written as the mention is: ``new`` for its first form, ``given`` for its second."""

    def fill(old: Column, kept: str) -> Column:
        gaps = F.split(F.regexp_replace(old, kept, "#"), "#", -1)
        return F.array_join(F.zip_with(gaps, characters(new), lambda gap, c: F.concat(F.coalesce(gap, F.lit("")), F.coalesce(c, F.lit("")))), "")

    title, first, family = name_parts(value)
    capitals = F.array_join(F.transform(F.split(given, "-"), F.initcap), "-")
    shouted = (F.upper(first) == first) & (F.lower(first) != first)
    new_given = F.when(first == "", "").otherwise(F.concat(F.when(shouted, F.upper(given)).otherwise(capitals), F.lit(" ")))
    name = F.concat(title, new_given, like(family, new))
    country = _country(value)
    phone = F.concat(country, fill(F.substring(value, F.length(country) + 1, F.length(value)), "[0-9]"))
    return F.when(kind == "name", name).when(kind == "phone", phone).when(kind.isin("ssn", "card"), fill(value, "[0-9]")).when(kind == "iban", fill(value, "[A-Z0-9]")).when(kind == "ip", new).otherwise(like(value, new))


def space(kind: Column, form: Column) -> tuple[Column, Column]:
    """The layout of a form, and the logarithm of the number of values that the layout has."""
    drawn = F.when(kind == "email", F.substring_index(form, "@", 1)).when(kind == "iban", F.substring(form, F.lit(3), F.length(form))).otherwise(form)
    classes = F.transform(characters(drawn), lambda c: let(alphabet_of(c), lambda a: F.struct(F.coalesce(F.substring(a, 1, 1), c).alias("mark"), F.log(F.coalesce(F.length(a), F.lit(1)).cast("double")).alias("size"))))
    marks = F.concat(F.array_join(F.transform(classes, lambda c: c["mark"]), ""), F.when(kind == "email", F.substring(form, F.instr(form, "@"), F.length(form))).otherwise(""))
    pooled = kind.isin("given male", "given female")
    marks = F.when(kind == "ip6", F.regexp_replace(F.regexp_replace(form, "[a-f]", "a"), "[0-9]", "0")).otherwise(marks)
    sizes = F.aggregate(F.transform(classes, lambda c: c["size"]), F.lit(0.0), lambda a, b: a + b) - F.when(kind == "card", F.log(F.lit(10.0))).otherwise(0.0)
    layout = F.when(pooled, "").when(kind == "ip", "").otherwise(marks)
    fixed = F.when(pooled, F.log(F.lit(20.0))).when(kind == "ip", F.lit(4.0) * F.log(F.lit(254.0)))
    return layout, fixed.when(kind == "ip6", F.length(F.regexp_replace(form, ":", "")) * F.log(F.lit(6.0))).otherwise(sizes)


def surrogate(kind: Column, form: Column, key: str, attempt: int, extra: Column) -> Column:
    """The candidate of one draw: same kind, same layout but for ``extra`` more characters (more names, for a given name)."""
    seed = lambda what, of=form: F.sha2(F.concat_ws("|", F.lit(key), F.lit(what), F.lit(str(attempt)), of), 256)
    local, domain = F.substring_index(form, "@", 1), F.substring_index(form, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    new_host = _replaced(host, F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain), 256))
    email = F.concat(_replaced(F.concat(F.repeat(F.lit("x"), extra), local), seed("email")), F.lit("@"), new_host, top)
    octets = F.transform(F.sequence(F.lit(1), 4 + extra), lambda i: (_draw(seed("ip"), i, 254) + 1).cast("string"))
    iban = F.concat(F.substring(form, 1, 2), _replaced(F.concat(F.substring(form, F.lit(3), F.length(form)), F.repeat(F.lit("0"), extra)), seed("iban")))
    digits = _replaced(F.concat(form, F.repeat(F.lit("0"), extra)), seed("digits"))
    letters = _replaced(F.concat(form, F.repeat(F.right(form, F.lit(1)), extra)), seed("name"))
    hexadecimal = lambda c, i: F.when(c.between("a", "f"), F.substring(F.lit("abcdef"), _draw(seed("ip6"), i, 6) + 1, F.lit(1))).otherwise(F.when(c == ":", c).otherwise(_draw(seed("ip6"), i, 10).cast("string")))
    ip6 = F.array_join(F.transform(characters(F.concat(form, F.repeat(F.lit("0"), extra))), hexadecimal), "")

    def pick(names: list[str]) -> Column:
        pool = F.array(*[F.lit(n.lower()) for n in names])
        return F.array_join(F.transform(F.sequence(F.lit(0), extra), lambda i: F.get(pool, _draw(seed("given"), i, len(names)))), "-")

    drawn = F.when(kind == "email", email).when(kind == "ip", F.array_join(octets, ".")).when(kind == "ip6", ip6).when(kind == "iban", iban).when(kind == "card", _card(form, digits))
    for gender, names in GIVEN.items():
        drawn = drawn.when((kind == f"given {gender}") & form.rlike(r"^[\p{IsLatin}-]+$"), pick(names))
    return drawn.when(kind.isin("family", "given", "given male", "given female"), letters).otherwise(digits)


def surrogate_table(found: DataFrame, key: str) -> DataFrame:
    """``kind``, ``form``, ``n``, ``surrogate`` for each distinct form of ``found`` (``kind``, ``form``).

    A surrogate is given to one form of a kind only and is itself no form of that kind in the table.
    Where a layout has fewer than twice as many values as forms, longer ones are drawn from the
    start, so at least every second draw is free; of forms that draw the same candidate the least
    keeps it, and the others draw again. Forms grow with the draws too, so each has one in the end.
    """
    layout, size = space(F.col("kind"), F.col("form"))
    counted = found.groupBy("kind", "form").agg(F.count("*").alias("n")).withColumns({"layout": layout, "size": size})
    crowds = counted.groupBy("kind", "layout").agg(F.count("*").alias("forms"))
    short = F.log(2 * F.col("forms").cast("double")) - F.col("size")
    per_extra = F.when(F.col("kind").startswith("given "), F.log(F.lit(20.0))).otherwise(F.log(F.lit(5.0)))
    extra = F.greatest(F.lit(0), F.ceil(short / per_extra)).cast("int")
    real = cut(counted.join(crowds, ["kind", "layout"]).select("kind", "form", "n", extra.alias("extra")))
    given, waiting = None, real
    for attempt in count():
        longer = F.col("extra") + attempt // PATIENCE
        drawn = waiting.withColumn("surrogate", surrogate(F.col("kind"), F.col("form"), key, attempt, longer))
        free = drawn.join(real.select("kind", F.col("form").alias("surrogate")), ["kind", "surrogate"], "left_anti")
        if given is not None:
            free = free.join(given.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min_by(F.struct("form", "n"), "form").alias("v"))
        won = cut(won.select("kind", "v.form", "v.n", "surrogate"))
        given = won if given is None else cut(given.union(won))
        waiting = cut(waiting.join(won, ["kind", "form"], "left_anti"))
        if waiting.isEmpty():
            return given


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Replaces the entities of whole texts by surrogates.

    Returns a row for each row of ``docs``: ``doc_id``, ``text`` (with surrogates), ``n_entities``,
    ``kinds`` (the entities' kinds in order). A null text counts as empty and has no entities.
    Repeated rows and null ids stay, an empty table gives an empty one, other columns are not read.
    The same ``key`` gives the same surrogates for the same set of entities. A given name whose
    gender one mention tells and another does not counts as two.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = F.transform("values", lambda v: F.struct(kind_of(v).alias("kind"), v.alias("value")))
    seen = base.withColumn("values", entities(F.col("text"))).withColumn("none", F.size("values") == 0)
    kept = F.when(F.col("none"), F.array("text")).otherwise(F.split("text", ANY, -1)).alias("gaps")
    seen = cut(seen.select("doc_id", F.monotonically_increasing_id().alias("row"), "none", kept, found.alias("found")))
    clean = seen.where("none").select("doc_id", F.get("gaps", F.lit(0)).alias("text"), F.lit(0).cast("bigint").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    hit = seen.where("NOT none")
    mentions = hit.select("row", F.posexplode("found").alias("place", "e")).select("row", "place", F.col("e.kind").alias("mention"), "e.value")
    parts = mentions.select("row", "place", "mention", "value", F.posexplode(forms(F.col("mention"), F.col("value"))).alias("part", "f")).select("row", "place", "mention", "value", "part", "f.kind", "f.form")
    table = surrogate_table(parts.select("kind", "form"), key)
    named = join_hot(parts, table, ["kind", "form"], "n", table.agg(F.sum("n")).first()[0] or 0)
    of = lambda part: F.max(F.when(F.col("part") == part, F.col("surrogate")))
    whole = named.groupBy("row", "place", "mention", "value").agg(of(0).alias("first"), of(1).alias("second"))
    rendered = whole.select("row", "place", written(F.col("mention"), F.col("value"), F.col("first"), F.col("second")).alias("new"))
    lists = rendered.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", "new"))).alias("new"))
    pieces = F.zip_with("gaps", "new", lambda gap, new: F.concat(gap, F.coalesce(new["new"], F.lit(""))))
    changed = hit.join(lists, "row").select("doc_id", F.array_join(pieces, "").alias("text"), F.size("found").cast("bigint").alias("n_entities"), F.transform("found", lambda e: e["kind"]).alias("kinds"))
    return clean.unionByName(changed)
