"""Surrogates for personal data: keyed, consistent in type, format, script and gender.

Entities are found by one pattern, once in each text.  An entity has one or two parts, each with a
canonical form (case, separators and country prefix removed): a person's first name and surname, an
address's local part and domain, else the whole.  One surrogate is drawn for each canonical part of
the corpus by HMAC-SHA256 under the caller's key: digits for digits, letters for letters, a first
name of the same gender and script, a card or account number whose check digits are right.  So all
mentions of an entity agree, however they are written: ``Petra Huber``, ``Frau Huber`` and
``Dr Huber`` have one surname, and all addresses of a domain stay in one domain.

No surrogate is drawn twice, nor is one a canonical form that occurs in the corpus (first names may:
the pool is small, and the surname tells people apart).  Those that collide (all but the first by
canonical form) are drawn again with the next attempt number.  Attempts have growing room: names,
addresses and domains get longer, numbers get digits, and from LAST_ATTEMPT on a surrogate ends in 16
digits of its hash, so the rounds end whatever the input.

A key of real use comes from a secret store; it is part of the query's plan, so plans are secret too.

Cases with a defined result
    null text: stays null, no entities; empty text: stays empty
    very long text: read whole; a long run of like characters is linear, and a long secret has no bound
    a number of 13 to 19 digits that is grouped as a card's: replaced if it has 16 digits or its check digit is right, else kept
    repeated rows: each gets its own result row, and all the same text
    null id: like any other id; extra columns, whatever their names, are not read
    two parts that draw the same surrogate: the first by canonical form has it, the other draws again
    one entity in very many documents: its rows are joined with exchanges on both sides, so split
    one document with very many entities: its replacements are put together in one task
    empty table: an empty result
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from .common import Scratch

#: Attempts with the usual room, and the attempt from which on a surrogate ends in a hash.
PLAIN_ATTEMPTS, LAST_ATTEMPT = 3, 16

#: First names by gender and script, and syllables of surnames.
FIRST_NAMES = {
    "m:latin": "James Robert Michael David William Thomas Daniel Hans Klaus Stefan Pierre Antoine Carlos José Miguel Javier Andrew Peter Matthew Jürgen Wolfgang Laurent Olivier Alejandro".split(),
    "f:latin": "Mary Anna Maria Laura Julia Sophie Claire Camille Isabelle Carmen Lucía Sabine Petra Emma Sarah Susan Elizabeth Jennifer Ursula Monika Nathalie Hélène Beatriz Mercedes".split(),
    "m:cyrillic": "Иван Сергей Дмитрий Алексей Михаил Андрей Николай Павел Владимир Юрий Виктор Олег".split(),
    "f:cyrillic": "Ольга Наталья Елена Татьяна Ирина Светлана Мария Анна Людмила Галина Марина Юлия".split(),
}
SYLLABLES = {
    "latin": "bar den fel gar hol kem lin mor nas per ros sal tor vel wen zim".split(),
    "cyrillic": "бар ден вол гор зим кам лин мор нас пер рос сал тор вел лес юр".split(),
}
HONORIFICS = {
    "m": ["Mr", "Herr", "Herrn", "Señor", "Monsieur", "г-н"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Mlle", "г-жа"],
    "u": ["Dr", "Prof"],
}
_TITLES = "|".join(t for ts in HONORIFICS.values() for t in sorted(ts, key=len, reverse=True))
_FIRST = "|".join(sorted({n for ns in FIRST_NAMES.values() for n in ns}, key=len, reverse=True))
_NAME = r"\p{Lu}[\p{L}'’-]{1,30}"
#: A known first name, as written or in capitals, perhaps joined to another.
_GIVEN = rf"(?:{_FIRST}|{_FIRST.upper()})(?:-\p{{Lu}}\p{{L}}{{1,30}})?"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_GROUP = "[0-9a-fA-F]{1,4}"

#: Kinds in the order in which they are tried at a place.  A quantifier without a bound is possessive or
#: starts at a fixed text, so a long run of like characters costs linear time.  The local part of an address
#: has 64 characters at most, and a label 63, as mail systems have it.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,63}(?![A-Za-z0-9])",
    "ipv6": rf"(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=[a-fA-F:]{{0,39}}[0-9])(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}})(?![0-9A-Za-z:])",
    "secret": r"(?:[0-9a-f]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{30,}+|sk-[A-Za-z0-9_-]{20,}+)(?![0-9A-Za-z])",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": rf"(?<!\.)(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![.+-])[3-6][0-9]{3}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9A-Za-z-])",
    "phone": (
        r"(?<![+-])(?:(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}"
        r"|\+[1-9][0-9]{0,2}(?:[ .()/-]{0,2}[0-9]){7,13}|\(?0[0-9]{2,4}(?:\) ?|[/ -])[0-9]{5,8})(?![0-9A-Za-z-])"
    ),
    "person": rf"(?:(?:{_TITLES})\.? {_NAME}(?: {_NAME})?|{_GIVEN} \p{{Lu}}(?:\p{{Ll}}{{2,30}}|\p{{Lu}}{{2,30}})(?:-\p{{Lu}}\p{{L}}{{1,30}})?(?![\p{{L}}\p{{M}}]))",
}
#: All kinds as one pattern.  No entity starts inside a word, and the first character says which kinds
#: are worth trying, so most places are passed over after one look.
_NUMBERS = "|".join(f"(?:{PATTERNS[k]})" for k in ("ip", "ssn", "card", "phone"))
ANY = (
    rf"(?<![\p{{L}}\p{{M}}\p{{N}}])(?:(?:{PATTERNS['email']})|(?=[0-9a-fA-Fgs])(?:(?:{PATTERNS['ipv6']})|(?:{PATTERNS['secret']}))"
    rf"|(?=[+(0-9])(?:{_NUMBERS})|(?=[\p{{Lu}}г])(?:(?:{PATTERNS['iban']})|(?:{PATTERNS['person']})))"
)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _array(values: list[str]) -> str:
    return "array(" + ", ".join(map(_sql, values)) + ")"


def _in(values: list[str]) -> str:
    return "(" + ", ".join(map(_sql, values)) + ")"


# --- what an entity is made of

_DIGITS = "regexp_replace(surface, '[^0-9]', '')"
#: A number of another length than 16 is a card's only if its check digit is right.
_ALSO = {"card": f" AND (length({_DIGITS}) = 16 OR luhn_check({_DIGITS}))"}
#: Kind of a whole entity.
KIND = "CASE " + " ".join(f"WHEN surface rlike {_sql(f'^(?:{p})$')}{_ALSO.get(k, '')} THEN '{k}'" for k, p in PATTERNS.items()) + " END"
_TITLE = f"regexp_extract(surface, {_sql(f'^((?:{_TITLES})[.]? )')}, 1)"
_NAMES = f"split(regexp_replace(surface, {_sql(f'^(?:{_TITLES})[.]? ')}, ''), ' ')"
_SCRIPT = r"CASE WHEN surface rlike '\\p{IsCyrillic}' THEN 'cyrillic' ELSE 'latin' END"
_KNOWN = {g: _in([n.lower() for n in FIRST_NAMES[f"{g}:latin"] + FIRST_NAMES[f"{g}:cyrillic"]]) for g in "mf"}
_GIVEN_NAME = f"substring_index(lower({_NAMES}[0]), '-', 1)"
_GENDER = (
    "CASE " + " ".join(f"WHEN {_GIVEN_NAME} IN {_KNOWN[g]} THEN '{g}'" for g in "mf") + " "
    + " ".join(f"WHEN surface rlike {_sql('^(?:' + '|'.join(HONORIFICS[g]) + ')[.]? ')} THEN '{g}'" for g in "mf") + " ELSE 'u' END"
)
#: Ends of surnames that take an -а for women.
_FEMININE = "(ов|ев|ёв|ин)а$"
_SURNAME = f"regexp_replace(lower(element_at({_NAMES}, -1)), '{_FEMININE}', '$1')"
_HAS_FIRST = f"(size({_NAMES}) = 2 OR {_GIVEN_NAME} IN {_KNOWN['m']} OR {_GIVEN_NAME} IN {_KNOWN['f']})"
_HAS_LAST = f"(size({_NAMES}) = 2 OR NOT {_HAS_FIRST})"


def _part(kind: str, canon: str, scope: str = "''", gender: str = "'u'") -> str:
    return f"named_struct('kind', '{kind}', 'scope', {scope}, 'canon', {canon}, 'gender', {gender})"


_DOMAIN = "lower(substring_index(surface, '@', -1))"
#: The parts of an entity: kind, scope (a scope has surrogates of its own), canonical form, gender.
PARTS = f"""CASE kind
  WHEN 'email' THEN array({_part('email', "lower(substring_index(surface, '@', 1))", _DOMAIN)}, {_part('domain', _DOMAIN)})
  WHEN 'person' THEN filter(array(CASE WHEN {_HAS_FIRST} THEN {_part('first', f'lower({_NAMES}[0])', _SCRIPT, _GENDER)} END,
                                  CASE WHEN {_HAS_LAST} THEN {_part('last', _SURNAME, _SCRIPT)} END), x -> x IS NOT NULL)
  WHEN 'secret' THEN array({_part('secret', 'surface')}) WHEN 'ip' THEN array({_part('ip', 'surface')}) WHEN 'ipv6' THEN array({_part('ipv6', 'lower(surface)')})
  WHEN 'iban' THEN array({_part('iban', "replace(surface, ' ', '')")}) WHEN 'ssn' THEN array({_part('ssn', _DIGITS)})
  WHEN 'card' THEN array({_part('card', _DIGITS)}) WHEN 'phone' THEN array({_part('phone', f'right({_DIGITS}, 10)')}) END"""


# --- draws


def _hmac(message: str, key: bytes) -> str:
    """HMAC-SHA256 of a string expression, as hex."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = ("X'" + bytes(b ^ pad for b in block).hex() + "'" for pad in (0x36, 0x5C))
    return f"sha2(concat({outer}, unhex(sha2(concat({inner}, cast({message} AS binary)), 256))), 256)"


def _byte(i: str) -> str:
    return f"cast(conv(substr(h, ({i}) % 64 * 2 + 1, 2), 16, 10) AS int)"


def _like(text: str) -> str:
    """Each digit and letter of ``text`` replaced by another of its class, by place."""
    b = _byte("i")
    return (
        f"array_join(transform(split({text}, ''), (c, i) -> CASE WHEN c rlike '^[0-9]$' THEN cast({b} % 10 AS string)"
        f" WHEN c rlike '^[a-z]$' THEN char(97 + {b} % 26) WHEN c rlike '^[A-Z]$' THEN char(65 + {b} % 26) ELSE c END), '')"
    )


#: Characters that an attempt adds to the usual room.
_MORE = f"greatest(attempt - {PLAIN_ATTEMPTS}, 0)"
_DECIMAL = "translate(h, 'abcdef', '135790')"
_LETTERS = "translate(h, '0123456789', 'ghijklmnop')"
_MORE_DIGITS = f"substr({_DECIMAL}, 80, {_MORE})"
_MORE_LETTERS = f"substr({_LETTERS}, 80, {_MORE})"


def _check_digits(account: str) -> str:
    """The two check digits of an IBAN whose other characters are ``account``, country first."""
    value = "CASE WHEN c rlike '^[0-9]$' THEN cast(c AS int) ELSE ascii(c) - 55 END"
    turned = f"concat(substr({account}, 3), substr({account}, 1, 2), '00')"
    rest = f"aggregate(split({turned}, ''), 0, (a, c) -> CASE WHEN c rlike '^[0-9]$' THEN (a * 10 + {value}) % 97 ELSE (a * 100 + {value}) % 97 END)"
    return f"lpad(cast(98 - {rest} AS string), 2, '0')"


def _syllables(count: str, first: str) -> str:
    pick = {s: f"array_join(transform(sequence(1, {count}), i -> element_at({_array(v)}, {_byte(f'i + {first}')} % {len(v)} + 1)), '')" for s, v in SYLLABLES.items()}
    return f"CASE scope WHEN 'cyrillic' THEN {pick['cyrillic']} ELSE {pick['latin']} END"


def _surrogate() -> str:
    """The surrogate of a part, from (kind, scope, canon, gender, attempt) and their hash ``h``."""
    end = "substring_index(canon, '.', -1)"
    domain = f"concat({_like(f'substr(canon, 1, length(canon) - length({end}) - 1)')}, {_MORE_LETTERS}, '.', {end})"
    start = f"concat(substr(canon, 1, 1), substr({_DECIMAL}, 1, length(canon) - 2))"
    checked = f"element_at(filter(transform(sequence(0, 9), d -> concat({start}, d)), n -> luhn_check(n)), 1)"
    card = f"concat(CASE WHEN luhn_check(canon) THEN {checked} ELSE concat(substr(canon, 1, 1), substr({_DECIMAL}, 1, length(canon) - 1)) END, {_MORE_DIGITS})"
    octet = [f"cast({_byte(str(i))} % 254 + 1 AS string)" for i in range(4)]
    # private networks stay private; later attempts of the small ones take the largest
    ip = (
        f"CASE WHEN canon LIKE '192.168.%' AND attempt < {PLAIN_ATTEMPTS} THEN concat_ws('.', '192.168', {octet[2]}, {octet[3]})"
        f" WHEN canon LIKE '10.%' OR canon LIKE '192.168.%' OR canon rlike '^172[.](1[6-9]|2[0-9]|3[01])[.]' THEN concat_ws('.', '10', {octet[1]}, {octet[2]}, {octet[3]})"
        f" WHEN canon LIKE '127.%' THEN concat_ws('.', '127', {octet[1]}, {octet[2]}, {octet[3]})"
        f" ELSE concat_ws('.', cast(element_at(array(11, 44, 80, 133, 151, 188, 203, 212), {_byte('0')} % 8 + 1) AS string), {octet[1]}, {octet[2]}, {octet[3]}) END"
    )
    hex_like = f"array_join(transform(split(canon, ''), (c, i) -> CASE WHEN c = ':' THEN c ELSE substr(h, i + 1, 1) END), '')"
    ipv6 = f"concat(substring_index(canon, ':', 1), substr({hex_like}, length(substring_index(canon, ':', 1)) + 1))"
    secret = f"CASE WHEN canon rlike '^[0-9a-f]+$' THEN array_join(transform(split(canon, ''), (c, i) -> substr(h, i % 128 + 1, 1)), '') ELSE concat(substr(canon, 1, 4), {_like('substr(canon, 5)')}) END"
    phone = f"concat(translate(substr({_DECIMAL}, 1, 1), '01', '23'), substr({_DECIMAL}, 2, length(canon) - 1), {_MORE_DIGITS})"
    account = f"concat(substr(canon, 1, 2), {_like('substr(canon, 5)')})"
    iban = f"concat(substr(canon, 1, 2), {_check_digits(account)}, substr({account}, 3), {_MORE_DIGITS})"
    pools = FIRST_NAMES | {f"u:{s}": FIRST_NAMES[f"m:{s}"] + FIRST_NAMES[f"f:{s}"] for s in SYLLABLES}
    name = "CASE concat(gender, ':', scope) " + " ".join(f"WHEN '{g}' THEN element_at({_array(v)}, {_byte('0')} % {len(v)} + 1)" for g, v in pools.items()) + " END"
    first = f"lower(concat({name}, CASE WHEN attempt > 2 * {PLAIN_ATTEMPTS} THEN {_syllables(f'attempt - 2 * {PLAIN_ATTEMPTS}', '1')} ELSE '' END))"
    last = f"concat({_syllables(f'3 + {_MORE}', '0')}, CASE scope WHEN 'cyrillic' THEN 'ов' ELSE '' END)"
    made = (
        f"CASE kind WHEN 'email' THEN concat({_like('canon')}, {_MORE_LETTERS}) WHEN 'domain' THEN {domain} WHEN 'card' THEN {card} WHEN 'ip' THEN {ip} WHEN 'ipv6' THEN {ipv6}"
        f" WHEN 'secret' THEN {secret} WHEN 'phone' THEN {phone} WHEN 'ssn' THEN concat(substr({_DECIMAL}, 1, length(canon)), {_MORE_DIGITS})"
        f" WHEN 'iban' THEN {iban} WHEN 'first' THEN {first} WHEN 'last' THEN {last} END"
    )
    return f"concat({made}, CASE WHEN attempt >= {LAST_ATTEMPT} THEN substr(h, 97, 16) ELSE '' END)"


def _fill(kept: str, taken: str, length: str) -> str:
    """``surface`` with its characters of class ``taken`` replaced in order, after the first ``kept``, and
    what the surrogate has beyond ``length`` at the end."""
    return (
        f"concat(aggregate(split(surface, ''), named_struct('o', '', 'k', 0), (a, c) -> CASE WHEN c rlike '^{taken}$' THEN"
        f" named_struct('o', concat(a.o, CASE WHEN a.k < {kept} THEN c ELSE substr(s[0], a.k - {kept} + 1, 1) END), 'k', a.k + 1)"
        f" ELSE named_struct('o', concat(a.o, c), 'k', a.k) END).o, substr(s[0], {length} + 1))"
    )


_BOTH = "concat(s[0], '@', s[1])"
_LAST = f"concat(element_at(s, -1), CASE WHEN lower(surface) rlike '{_FEMININE}' THEN 'а' ELSE '' END)"
#: A joined surname gets a joined one.
_WRITTEN_LAST = f"CASE WHEN element_at({_NAMES}, -1) LIKE '%_-_%' THEN concat(initcap(substr({_LAST}, 1, length({_LAST}) DIV 2)), '-', initcap(substr({_LAST}, length({_LAST}) DIV 2 + 1))) ELSE initcap({_LAST}) END"
_PERSON = f"CASE WHEN NOT {_HAS_LAST} THEN initcap(s[0]) WHEN size(s) = 2 THEN concat(initcap(s[0]), ' ', {_WRITTEN_LAST}) ELSE {_WRITTEN_LAST} END"
#: An entity's surrogate in the format of a mention, from (kind, surface) and the parts' surrogates ``s``.
WRITTEN = f"""CASE
  WHEN kind IN ('ssn', 'card') THEN {_fill('0', '[0-9]', f'length({_DIGITS})')}
  WHEN kind = 'phone' THEN {_fill(f'greatest(length({_DIGITS}) - 10, 0)', '[0-9]', f'least(length({_DIGITS}), 10)')}
  WHEN kind = 'iban' THEN {_fill('0', '[0-9A-Z]', "length(replace(surface, ' ', ''))")}
  WHEN kind = 'email' THEN CASE WHEN surface = upper(surface) THEN upper({_BOTH})
    ELSE array_join(transform(split({_BOTH}, ''), (c, i) -> CASE WHEN substr(surface, i + 1, 1) rlike '^[A-Z]$' THEN upper(c) ELSE c END), '') END
  WHEN kind = 'person' THEN concat({_TITLE}, CASE WHEN array_join({_NAMES}, ' ') = upper(array_join({_NAMES}, ' ')) THEN upper({_PERSON}) ELSE {_PERSON} END)
  ELSE s[0] END"""


def assign(parts: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """(kind, scope, canon, s): a surrogate for each distinct (kind, scope, canon, gender), none of them twice
    in its kind and scope."""
    names = ["kind", "scope", "canon"]
    message = "concat_ws('|', {0}, kind, scope, canon, cast(attempt AS string))"
    h = f"concat({_hmac(message.format(1), key)}, {_hmac(message.format(2), key)})"
    real = parts.where("kind <> 'first'").select(*names)
    open_ = parts.select(*names, "gender", F.lit(0).alias("attempt"))
    done: DataFrame | None = None
    while True:
        drawn = scratch.cut(open_.withColumn("h", F.expr(h)).withColumn("s", F.expr(_surrogate())).drop("h"), "drawn")
        first = drawn.where("s <> canon").groupBy("kind", "scope", "s").agg(F.min("canon").alias("canon"))
        taken = real if done is None else real.unionByName(done.select("kind", "scope", F.col("s").alias("canon")))
        good = first.join(taken.withColumnRenamed("canon", "s"), ["kind", "scope", "s"], "left_anti")
        good = scratch.cut(good.select(*names, "s"), "accepted")
        rest = drawn.join(good.select(*names), names, "left_anti").select(*names, "gender", (F.col("attempt") + 1).alias("attempt"))
        done = good if done is None else done.unionByName(good)
        if rest.isEmpty():
            return done
        open_ = rest


def replacements(surfaces: DataFrame, key: bytes, scratch: Scratch) -> DataFrame:
    """(surface, written) of each distinct entity ``surfaces.surface``."""
    forms = surfaces.withColumn("kind", F.expr(KIND)).where("kind IS NOT NULL")
    met = scratch.cut(forms.select("surface", F.col("kind").alias("entity"), F.posexplode(F.expr(PARTS)).alias("pos", "p")).select("surface", "entity", "pos", "p.*"), "parts")
    # a first name has one gender: what the list or a title says, where any mention does
    distinct = met.groupBy("kind", "scope", "canon").agg(F.min("gender").alias("gender"))
    drawn = assign(distinct, key, scratch)
    whole = met.join(drawn, ["kind", "scope", "canon"]).groupBy("surface", F.col("entity").alias("kind"))
    s = F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"])  # two parts at most
    return whole.agg(s.alias("s")).select("surface", F.expr(WRITTEN).alias("written"))


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text, n_entities) of every document, its entities replaced under the caller's secret ``key``."""
    if not key:
        raise ValueError("a key is needed: surrogates are only as secret as it is")
    scratch = scratch or Scratch(docs.sparkSession, "pii")
    found = F.coalesce(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), F.array().cast("array<string>"))
    seen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn("found", found)
    touched = F.size("found") > 0
    # texts are read and searched once: a clean one is kept as it is, another in pieces
    seen = scratch.cut(
        seen.select(
            "doc_id", F.monotonically_increasing_id().alias("row"), F.when(~touched, F.col("text")).alias("text"),
            F.when(touched, F.split("text", ANY, -1)).alias("pieces"), F.when(touched, F.col("found")).alias("found"),
        ),
        "searched",
    )
    mentions = seen.where("found IS NOT NULL").select("row", F.posexplode("found").alias("pos", "surface"))
    written = scratch.cut(replacements(mentions.select("surface").distinct(), key, scratch), "written").withColumnRenamed("surface", "form")
    listed = (
        mentions.join(written, F.col("surface") == F.col("form"), "left").groupBy(F.col("row").alias("_row"))
        .agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("written", "surface").alias("w")))).alias("l"), F.count("written").cast("int").alias("n"))
    )
    again = F.array_join(F.zip_with("pieces", F.transform("l", lambda x: x["w"]), lambda p, w: F.concat(p, F.coalesce(w, F.lit("")))), "")
    clean = seen.where("found IS NULL").select("doc_id", "text", F.lit(0).alias("n_entities"))
    joined = seen.where("found IS NOT NULL").select("doc_id", "row", "pieces").join(listed, F.col("row") == F.col("_row"))
    return clean.unionByName(joined.select("doc_id", again.alias("text"), F.col("n").alias("n_entities")))
