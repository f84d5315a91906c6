"""Surrogates for personal data, by DataFrame functions only.

Entities are found by one pattern; each gets a surrogate that is a function of a secret key, its type and its canonical form (no
separators, one case), so the same entity has the same surrogate in every document and spelling. The form is kept: digits
stay digits, letters letters of the same script and case, separators stay; numbers keep their country's code and leading zero, cards their first
digit and a valid check digit if they had one, access keys their prefix; addresses stay addresses.

Names are found behind a title. Every word of a name is an entity, given names (with the gender that the title tells) and
surnames; a word so found is replaced wherever else it stands in its document, in that spelling or in capitals. The title is no
part of the key: a given name behind a neutral title is that of its gendered mentions in the document, else of the most frequent
ones in the table. Latin, Cyrillic, Greek and Armenian names are found, and get names of their script; names in other scripts are left alone.

Collisions are looked for over the distinct entities of the whole table: of two entities with one surrogate, or where a
surrogate is itself an entity of the table, the later one takes another attempt, with longer names from the third on. Where a
form has too few values for that (four digits, one-letter addresses), the entities of that form swap theirs after ATTEMPTS rounds, so the
rounds always end. Only these exceptions are joined back, by the documents that hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.llm.shared import discard, documents, materialize

#: The key of the registered query; a job passes its own, which is secret.
DEMONSTRATION_KEY = "marlstone"
#: Rounds after which forms that are still short of surrogates swap theirs.
ATTEMPTS = 12
#: Titles before names, by the gender they tell.
MALE = "Mr|Herrn?|Monsieur|Señor|Sr|Г-н|господин|Κύριος|Κος|Պարոն"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Г-жа|госпожа|Κυρία|Κα|Տիկին"
NEUTRAL = "Dr|Prof|Д-р|Проф"
#: Small words inside names, which stay.
PARTICLES = "van|von|der|den|de|del|della|di|da|la|le|du|bin|ibn|al|zu"
#: Syllables of surrogate names, and ends of given names by gender, for each script.
SYLLABLES = {
    "Latin": ["bal", "cor", "den", "fal", "gar", "hel", "jor", "kel", "lam", "mar", "nor", "pel", "ran", "sol", "tam", "ver"],
    "Cyrillic": ["бал", "вер", "гор", "дан", "зор", "кал", "лад", "мир", "нов", "пер", "рад", "сол", "тар", "фед", "хол", "яр"],
    "Greek": ["βαλ", "γορ", "δαν", "ζερ", "θαλ", "καρ", "λαμ", "μαρ", "νικ", "παλ", "ραν", "σολ", "ταρ", "φαν", "χαρ", "ψαλ"],
    "Armenian": ["բալ", "գոր", "դան", "զար", "թալ", "կար", "լամ", "մար", "նար", "պետ", "ռան", "սոլ", "տար", "վեր", "քալ", "ֆեր"],
}
ENDS = {
    "Latin": {"m": "us", "f": "ina", "n": "el"}, "Cyrillic": {"m": "ан", "f": "ина", "n": "ий"},
    "Greek": {"m": "ος", "f": "ινα", "n": "ι"}, "Armenian": {"m": "ոս", "f": "ինա", "n": "իկ"},
}
#: Letters that take the place of letters of a script.
LETTERS = {
    "Latin": "abcdefghijklmnopqrstuvwxyz", "Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω",
    "Armenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ",
}
#: Country calling codes have one digit (1 and 7), two (these) or three.
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"

_W = r"[\p{L}\p{N}]"
_CASED = r"[\p{Lu}&&[\p{IsLatin}\p{IsCyrillic}\p{IsGreek}\p{IsArmenian}]]"
#: One word of a name, without a genitive's apostrophe and s.
_WORD = rf"{_CASED}(?:\p{{L}}|['’](?!s(?!\p{{L}}))\p{{L}})\p{{L}}*+(?:(?!['’]s(?!\p{{L}}))['’-]\p{{L}}++(?!\p{{N}}))*+"
_TITLE = rf"(?:{MALE}|{FEMALE}|{NEUTRAL})\.? "
_HEX = "[0-9a-fA-F]{1,4}"
#: What each type looks like; none begins inside a word. No group is repeated without a bound but a possessive one, which takes no stack, and what
#: can begin again and again in one run of characters is bounded (local parts 255, labels 63, hosts 128 labels), so that time is linear in the text.
TYPES = {
    "email": r"[\p{L}\p{N}][\p{L}\p{N}._%+-]{0,254}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){0,126}\.\p{L}{2,63}+",
    "ip": r"(?<!\.)(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "ipv6": rf"(?<!:)(?:(?:{_HEX}:){{7}}{_HEX}|[0-9a-fA-F]{{4}}:(?:{_HEX}:){{0,5}}(?::{_HEX}){{1,6}})(?![\p{{L}}\p{{N}}:])",
    "secret": rf"(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{{32,64}}(?!{_W})",
    "ssn": r"(?<!-)\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "phone": (
        r"(?<!\.)(?:(?=\+(?:[ .()-]{0,2}\d){7})\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,8}(?:[ .-]\d{2,8}){0,5}|\(\d{3}\) ?\d{3}[ .-]\d{4}"
        rf"|\d{{3}}(?<gap>[-. ])\d{{3}}\k<gap>\d{{4}}|0\d{{2,4}}(?<stop>[ -])\d{{3,4}}\k<stop>\d{{3,4}}|0\d{{2,4}}/\d{{5,8}})(?!{_W})"
    ),
    "card": rf"(?<!\.)(?:\d{{13,19}}|\d{{4}}(?<part>[ -])\d{{4}}\k<part>\d{{4}}\k<part>\d{{1,7}})(?!{_W})",
    "token": (
        r"(?:A[KS]IA[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36}|AIza[0-9A-Za-z_-]{35}|xox[abprs]-[0-9A-Za-z-]{10,255}|sk-[0-9A-Za-z_-]{20,255}"
        rf"|eyJ[0-9A-Za-z_-]{{10,2000}}+\.[0-9A-Za-z_-]{{10,8000}}+\.[0-9A-Za-z_-]{{10,2000}})(?!{_W})"
    ),
    "iban": rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?!{_W})",
    "name": rf"(?:{_TITLE}){{1,3}}(?:(?:{PARTICLES}) ){{0,2}}{_WORD}(?: (?:(?:{PARTICLES}) ){{0,2}}{_WORD}){{0,2}}(?!{_W})",
}
_TITLED = "".join(sorted({t[0] for t in f"{MALE}|{FEMALE}|{NEUTRAL}".split("|")}))
#: Types by the characters that they can begin with, so that most places of a text are passed over at once.
BEGIN = {r"[\p{L}\p{N}]": ["email"], "[0-9a-fA-F(+]": ["ip", "ipv6", "secret", "ssn", "phone", "card"], "[A-Zegsx]": ["token", "iban"], f"[{_TITLED}]": ["name"]}
PATTERN = rf"(?<!{_W})(?:" + "|".join(f"(?={first})(?:{'|'.join(TYPES[t] for t in own)})" for first, own in BEGIN.items()) + ")"
PREFIX = r"^(?:A[KS]IA|gh[opsu]_|AIza|xox[abprs]-|sk-|eyJ)"


def _type(m: Column) -> Column:
    """The type of a match; ``bare`` for a name that is known from elsewhere in its document."""
    out = F.lit("bare")
    for name, pattern in reversed(TYPES.items()):
        out = F.when(m.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _canon(m: Column, kind: Column) -> Column:
    digits = F.regexp_replace(m, r"\D", "")
    # a North American number is the same with and without its country's code
    near = F.when(m.startswith("+") & ~((F.length(digits) == 11) & digits.startswith("1")), F.concat(F.lit("+"), digits)).when(F.length(digits) == 11, F.right(digits, F.lit(10))).otherwise(digits)
    return (
        F.when(kind.isin("card", "ssn"), digits).when(kind == "phone", near).when(kind == "iban", F.replace(m, F.lit(" "), F.lit("")))
        .when(kind == "token", m).otherwise(F.lower(m))
    )


def _words(m: Column) -> Column:
    """The words of a match behind its titles."""
    return F.split(F.regexp_replace(m, f"^(?:{_TITLE})+", ""), " ")


def _gender(m: Column) -> Column:
    return F.when(m.rlike(rf"(?:^|^[^ ]+ |^[^ ]+ [^ ]+ )(?:{MALE})\.? "), "m").when(m.rlike(rf"(?:^|^[^ ]+ |^[^ ]+ [^ ]+ )(?:{FEMALE})\.? "), "f").otherwise("n")


def _is_name(w: Column) -> Column:
    return ~w.isin(*PARTICLES.split("|"))


def _known(names: Column) -> Column:
    """array<struct(word, canon, role, gender)> of the words of the matches with titles; a word that is alone behind a title has no role of its own."""

    def one(m: Column) -> Column:
        words = F.filter(_words(m), _is_name)
        role = lambda i: F.when(F.size(words) == 1, "single").when(i == F.size(words) - 1, "surname").otherwise("given")
        return F.transform(words, lambda w, i: F.struct(w.alias("word"), F.lower(w).alias("canon"), role(i).alias("role"), _gender(m).alias("gender")))

    # distinct structs are found by comparing all, distinct strings by hashing; a word has no line end
    lines = F.array_distinct(F.flatten(F.transform(F.array_distinct(names), lambda m: F.transform(one(m), lambda k: F.concat_ws("\n", k["word"], k["canon"], k["role"], k["gender"])))))
    return F.transform(F.transform(lines, lambda x: F.split(x, "\n")), lambda x: F.struct(*[x[i].alias(c) for i, c in enumerate(("word", "canon", "role", "gender"))]))


def _parts(m: Column, kind: Column, known: Column) -> Column:
    """The entities of a match as array<struct(type, canon)>: of a name one for each word, null for words that stay; other matches are one."""

    def named(w: Column, own: Column, last: Column, alone: Column) -> Column:
        canon = F.lower(w)
        roles = F.transform(F.filter(known, lambda k: k["canon"] == canon), lambda k: k["role"])
        genders = F.transform(F.filter(known, lambda k: (k["canon"] == canon) & (k["role"] == "given") & (k["gender"] != "n")), lambda k: k["gender"])
        given = F.when(alone, F.array_contains(roles, "given") & ~F.array_contains(roles, "surname")).otherwise(~last)
        gender = F.when(own != "n", own).otherwise(F.coalesce(F.try_element_at(genders, F.lit(1)), F.lit("n")))
        return F.struct(F.when(given, F.concat(F.lit("given_"), gender)).otherwise("surname").alias("type"), canon.alias("canon"))

    words = _words(m)
    count = F.size(F.filter(words, _is_name))
    titled = F.transform(words, lambda w, i: F.when(_is_name(w), named(w, _gender(m), i == F.size(words) - 1, count == 1)))
    bare = F.array(named(m, F.lit("n"), F.lit(True), F.lit(True)))
    return F.when(kind == "name", titled).when(kind == "bare", bare).otherwise(F.array(F.struct(kind.alias("type"), _canon(m, kind).alias("canon"))))


def _stream(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """Keyed hex digits, four for each character of the canonical form; names need 16 of them at most, and long forms are hashed once."""
    size = F.when(kind.isin("surname", "given_m", "given_f", "given_n"), 0).otherwise(F.length(canon))
    short = F.when(F.length(canon) > 255, F.sha2(canon.cast("binary"), 256)).otherwise(canon)
    digits = lambda c: F.array_join(F.transform(F.sequence(F.lit(0), F.floor(size / 16).cast("int")), lambda b: F.sha2(F.concat_ws("|", F.lit(key), kind, attempt.cast("string"), b.cast("string"), c).cast("binary"), 256)), "")
    return F.transform(F.array(short), digits)[0]


def _number(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, i * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid last digit, and 0 to 9, the last digit that would be valid."""
    d = F.reverse(F.split(digits, ""))
    d = F.transform(F.filter(d, lambda x: x != ""), lambda x, i: F.when(i % 2 == 1, x.cast("int") * 2 - F.when(x.cast("int") > 4, 9).otherwise(0)).otherwise(x.cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, x: a + x) % 10


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form of the surrogate of an entity."""
    # the array of one binds the stream to a name, so that it is hashed once
    return F.transform(F.array(_stream(kind, canon, attempt, key)), lambda s: _from_stream(kind, canon, attempt, s))[0]


def _from_stream(kind: Column, canon: Column, attempt: Column, s: Column) -> Column:
    chars = F.filter(F.split(canon, ""), lambda c: c != "")
    pick = lambda letters, n: F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))
    at = F.length(F.regexp_extract(canon, r"^[^@]*", 0))  # the last label of a domain stays
    # characters in front that stay: a country's code, a leading zero, a card's first digit, a bank's country, an access key's prefix
    front = (
        F.when(kind == "phone", F.length(F.regexp_extract(canon, rf"^(?:\+(?:{CALLING})|0)", 0))).when(kind == "card", 1).when(kind == "iban", 2)
        .when(kind == "token", F.length(F.regexp_extract(canon, PREFIX, 0))).when(kind == "ipv6", F.length(F.regexp_extract(canon, "^[0-9a-f]*", 0))).otherwise(0)
    )
    keep = F.when(kind == "email", F.length(canon) - F.length(F.regexp_extract(canon, r"[^.]*$", 0))).otherwise(F.length(canon))
    like = F.array_join(
        F.transform(chars, lambda c, i: (
            F.when((i < front) | (kind == "email") & (i > at) & (i >= keep), c)
            .when(kind.isin("secret", "ipv6") & c.rlike("[0-9a-f]"), pick("0123456789abcdef", _number(s, i)))
            # the first digit of an area and, in North America, of an exchange
            .when((kind == "phone") & c.rlike("[2-9]") & ((i == front) | (F.length(canon) == 10) & (i == 3)), pick("23456789", _number(s, i)))
            .when(c.rlike("[0-9]"), pick("0123456789", _number(s, i)))
            .when(c.rlike("[A-Z]"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _number(s, i)))
            .when(c.rlike(r"\p{IsCyrillic}"), pick(LETTERS["Cyrillic"], _number(s, i)))
            .when(c.rlike(r"\p{IsGreek}"), pick(LETTERS["Greek"], _number(s, i)))
            .when(c.rlike(r"\p{IsArmenian}"), pick(LETTERS["Armenian"], _number(s, i)))
            .when(c.rlike(r"\p{L}"), pick(LETTERS["Latin"], _number(s, i)))
            .otherwise(c)
        )), "",
    )
    body = F.substring(like, F.lit(1), F.length(like) - 1)
    card = F.when(_luhn(canon) == 0, F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))).otherwise(like)
    ip = F.array_join(F.transform(F.split(canon, r"\."), lambda o, i: (_number(s, i) % 254 + 1).cast("string")), ".")

    def name(script: str) -> Column:
        part = lambda j: F.element_at(F.array(*map(F.lit, SYLLABLES[script])), _number(s, j) % len(SYLLABLES[script]) + 1)
        end = F.lit("")
        for g, x in ENDS[script].items():
            end = F.when(kind == f"given_{g}", x).otherwise(end)
        # names of one table can be many: each attempt from the third on has a syllable more, up to 12
        more = F.when(attempt > 2, F.array_join(F.transform(F.sequence(F.lit(4), F.least(attempt + 1, F.lit(14))), part), "")).otherwise(F.lit(""))
        return F.concat(part(F.lit(0)), part(F.lit(1)), part(F.lit(2)), F.when(kind == "surname", part(F.lit(3))).otherwise(F.lit("")), more, end)

    # a stream has at least 16 numbers, whatever the length of the canonical form
    named = name("Latin")
    for script in ("Cyrillic", "Greek", "Armenian"):
        named = F.when(canon.rlike(rf"^\p{{Is{script}}}"), name(script)).otherwise(named)
    return F.when(kind == "card", card).when(kind == "ip", ip).when(kind.isin("surname", "given_m", "given_f", "given_n"), named).otherwise(like)


def _cased(word: Column, to: Column) -> Column:
    return F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(to)).otherwise(F.initcap(to))


def _written(m: Column, kind: Column, to: Column) -> Column:
    """The surrogates ``to`` (array of canonical forms) in the spelling of the match."""
    letters = F.filter(F.split(m, ""), lambda c: c != "")
    one = to[0]
    # a North American number with its country's code keeps that
    skip = F.when((kind == "phone") & ~one.startswith("+"), F.length(F.regexp_replace(m, r"\D", "")) - F.length(one)).otherwise(F.lit(0))
    start = F.struct((F.lit(0) - skip).cast("int").alias("i"), F.lit("").alias("out"))
    counted = _has_place(kind)

    def step(acc: Column, c: Column) -> Column:
        new = F.substring(one, acc["i"] + 1, F.lit(1))
        new = F.when(acc["i"] < 0, c).when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)
        return F.when(counted(c, one), F.struct((acc["i"] + 1).cast("int").alias("i"), F.concat(acc["out"], new).alias("out"))).otherwise(F.struct(acc["i"].alias("i"), F.concat(acc["out"], c).alias("out")))

    title = F.regexp_extract(m, f"^(?:{_TITLE})+", 0)
    names = F.array_join(F.zip_with(_words(m), to, lambda w, t: F.coalesce(_cased(w, t), w)), " ")
    return (
        F.when(kind == "name", F.concat(title, names)).when(kind == "bare", _cased(m, one))
        .when(kind == "ip", one).otherwise(F.aggregate(letters, start, step, lambda acc: acc["out"]))
    )


def _has_place(kind: Column):
    """Whether a character of a match has a place in the canonical form."""
    return lambda c, one: c.rlike("[0-9]") | (c == "+") & (kind == "phone") & one.startswith("+") | ~kind.isin("phone", "card", "ssn") & ((c != " ") | (kind != "iban"))


def _worked_out(docs: DataFrame, name: str, value: Column) -> DataFrame:
    """docs with a column that is worked out once for each row: without the generator, Spark would move its expression into what is done for each element of an array."""
    return docs.select(*[c for c in docs.columns if c != name], F.explode(F.array(value)).alias(name))


def _found(docs: DataFrame) -> DataFrame:
    """docs with _pattern, and _found: array<struct(m, kind, parts)> of the matches of text, in order; null where there are none."""
    docs = _worked_out(docs, "_hits", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    docs = _worked_out(docs, "_known", _known(F.filter("_hits", lambda m: m.rlike(f"^{_TITLE}"))))
    words = F.array_distinct(F.transform("_known", lambda k: k["word"]))
    # of two names that begin alike the longer one comes first
    words = F.reverse(F.array_sort(F.array_distinct(F.concat(words, F.transform(words, lambda w: F.upper(w))))))
    names = F.concat(F.lit(rf"{PATTERN}|(?<!{_W})(?:"), F.array_join(words, "|"), F.lit(rf")(?!{_W})"))
    docs = _worked_out(docs, "_pattern", F.when(F.size("_known") > 0, names).otherwise(F.lit(PATTERN)))
    docs = _worked_out(docs, "_hits", F.when(F.size("_known") > 0, F.regexp_extract_all("text", F.col("_pattern"), F.lit(0))).otherwise(F.col("_hits")))
    docs = _worked_out(docs, "_kinds", F.transform("_hits", lambda m: F.struct(m.alias("m"), _type(m).alias("kind"))))
    found = F.transform("_kinds", lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), _parts(x["m"], x["kind"], F.col("_known")).alias("parts")))
    return _worked_out(docs, "_found", found).drop("_hits", "_known", "_kinds")


def _exceptions(entities: DataFrame, key: str) -> DataFrame:
    """entities(type, canon), one row for each occurrence -> (type, canon, to) of those that don't have their first surrogate."""
    counted = materialize(entities.groupBy("type", "canon").count(), "counted")
    # a given name of no known gender is the most frequent one of the table that has one
    gendered = counted.filter(F.col("type").isin("given_m", "given_f")).groupBy("canon").agg(F.max(F.struct("count", "type"))["type"].alias("as"))
    alias = materialize(counted.filter("type = 'given_n'").join(gendered, "canon").select("type", "canon", "as"), "aliases")
    own = counted.join(alias, ["type", "canon"], "left_anti").select("type", "canon")
    found = _settled(own, key)
    same = found.select(F.col("type").alias("as"), "canon", "to")
    first = surrogate(F.col("as"), F.col("canon"), F.lit(0), key)
    aliased = alias.join(same, ["as", "canon"], "left").select("type", "canon", F.coalesce("to", first).alias("to"))
    out = materialize(found.unionByName(aliased), "exceptions")
    discard(counted, alias, found)
    return out


def _settled(entities: DataFrame, key: str) -> DataFrame:
    """(type, canon, to) of the distinct entities whose first surrogate is taken."""
    family = F.when(F.col("type").rlike("^(given_.|surname)$"), "name").otherwise(F.col("type"))  # names of any kind must differ from each other
    entities = materialize(entities.withColumn("attempt", F.lit(0)), "entities")
    for k in range(ATTEMPTS + 1):
        tried = materialize(entities.withColumn("to", surrogate(F.col("type"), F.col("canon"), F.col("attempt"), key)).withColumn("family", family), "tried")
        # attempts taken earlier win over later ones, then the smaller entity
        order = F.struct("attempt", "type", "canon")
        clash = tried.groupBy("family", "to").agg(F.min("attempt").alias("attempt"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n", "attempt")
        clash = tried.join(clash, ["family", "to"]).groupBy("family", "to").agg(F.min(order).alias("first"))
        real = tried.select("family", F.col("canon").alias("to")).distinct()
        losers = tried.join(clash, ["family", "to"]).filter(order != F.col("first")).select("type", "canon")
        losers = losers.unionByName(tried.join(real, ["family", "to"], "left_semi").select("type", "canon")).distinct().withColumn("lost", F.lit(1))
        losers = materialize(losers, "losers")
        if losers.isEmpty():
            out = materialize(tried.filter("attempt > 0").select("type", "canon", "to"), "settled")
        elif k == ATTEMPTS:
            out = materialize(_swapped(tried, losers, key), "settled")
        else:
            out = None
            after = materialize(entities.join(losers, ["type", "canon"], "left").select("type", "canon", (F.col("attempt") + F.coalesce("lost", F.lit(0))).alias("attempt")), "entities")
        discard(entities, tried, losers)
        if out is not None:
            return out
        entities = after


def _swapped(tried: DataFrame, losers: DataFrame, key: str) -> DataFrame:
    """(type, canon, to), where all entities of a loser's family and form take each other's canonical forms in a keyed circle.

    Other forms' surrogates are no entities of the table and not of this form, so all stay distinct. An entity alone in its form keeps its last attempt.
    """
    form = F.when(F.col("family").isin("name", "ip"), "").otherwise(F.regexp_replace(F.regexp_replace("canon", r"[0-9]", "0"), r"\p{L}", "a"))
    formed = tried.withColumn("form", form)
    full = formed.join(losers, ["type", "canon"], "left_semi").select("family", "form").distinct().withColumn("full", F.lit(1))
    circle = Window.partitionBy("family", "form").orderBy(F.sha2(F.concat_ws("|", F.lit(key), "canon").cast("binary"), 256), "canon", "type")
    rows = formed.join(full, ["family", "form"])
    after = F.coalesce(F.lead("canon").over(circle), F.first("canon").over(circle))
    swapped = rows.withColumn("after", after).select("type", "canon", F.when(F.col("after") == F.col("canon"), F.col("to")).otherwise(F.col("after")).alias("to"))
    rest = formed.join(full, ["family", "form"], "left_anti").filter("attempt > 0").select("type", "canon", "to")
    return swapped.unionByName(rest)


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """docs(doc_id, text, ...) with surrogates in text, and n_entities, the number of matches replaced.

    Two different entities of a type never get one surrogate, an entity always gets the same one, and no surrogate is an entity of the
    table, but where the entities of a form fill so much of its values that they swap theirs. A word that is a given name and a surname is two
    entities; alone it is the surname, unless its document knows it as a given name only. Null texts stay null with n_entities 0; empty texts
    and texts without entities stay as they are; repeated rows are alike. All rows and columns stay; a column named n_entities is
    replaced, and columns named _found, _pattern or _odd are lost. No rows give no rows. Long texts are rewritten whole.
    """
    docs = docs.drop("n_entities", "_found", "_pattern", "_odd", "_odd_id", "_odd_h", "_hits", "_known", "_kinds")
    found = _found(docs)
    hash_of = F.xxhash64("text")
    narrow = found.filter(F.size("_found") > 0).select("doc_id", hash_of.alias("h"), F.flatten(F.transform("_found", lambda f: f["parts"])).alias("parts"))
    narrow = materialize(narrow.select("doc_id", "h", F.filter("parts", lambda p: p.isNotNull()).alias("parts")), "mentions")
    mentions = narrow.select("doc_id", "h", F.explode("parts").alias("p")).select("doc_id", "h", "p.type", "p.canon")
    odd = _exceptions(mentions.select("type", "canon"), key)
    other = lambda p: F.lit(None).cast("string")
    if not odd.isEmpty():
        name = F.concat_ws("|", "type", "canon")
        per = mentions.distinct().join(odd, ["type", "canon"]).groupBy("doc_id", "h").agg(F.map_from_entries(F.collect_list(F.struct(name.alias("k"), F.col("to").alias("v")))).alias("_odd"))
        per = materialize(per.withColumnsRenamed({"doc_id": "_odd_id", "h": "_odd_h"}), "odd")
        found = found.join(per, F.col("doc_id").eqNullSafe(F.col("_odd_id")) & (hash_of == F.col("_odd_h")), "left").drop("_odd_id", "_odd_h")
        other = lambda p: F.try_element_at(F.col("_odd"), F.concat_ws("|", p["type"], p["canon"]))
    discard(narrow, odd)
    made = lambda f: F.transform(f["parts"], lambda p: F.when(p.isNotNull(), F.coalesce(other(p), surrogate(p["type"], p["canon"], F.lit(0), key))))
    # again an array of one, so that surrogates are made once for a match and not for each of its characters
    to = F.transform("_found", lambda f: F.transform(F.array(made(f)), lambda t: _written(f["m"], f["kind"], t))[0])
    gaps = F.split("text", F.col("_pattern"))
    text = F.concat(gaps[0], F.array_join(F.zip_with(to, F.slice(gaps, 2, F.size("_found")), lambda a, b: F.concat(a, b)), ""))
    counts = F.greatest(F.coalesce(F.size("_found"), F.lit(0)), F.lit(0)).cast("long")
    return found.withColumns({"text": F.when(F.size("_found") > 0, text).otherwise(F.col("text")), "n_entities": counts}).drop("_found", "_odd", "_pattern")


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return replace_pii(docs, DEMONSTRATION_KEY).select("doc_id", "n_entities", "text")
