"""Personal data: detected entities get keyed surrogates of the same type.

One entity has one surrogate wherever it occurs (coreference), and two entities of a type never share one
(distinctness). A surrogate is drawn from a keyed hash of type and normalized form and keeps the form of what it
replaces: digits and letters change, separators, length, case and script stay; card numbers keep their issuer
digit and a valid check digit, names their gender and script. All candidate surrogates of the corpus are
compared by Spark: whoever collides with another entity's surrogate, or with an entity that really occurs, draws
again with the next counter. Only texts with entities go through the exchange.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import secrets
from bisect import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import materialize

#: Setting of the session that holds the secret from which surrogates are drawn.
KEY_SETTING = "spark.lodestone.surrogate.key"
#: The draw from which surrogates get longer; later draws of domains that are broadcast at most.
LONGER_FROM, BROADCAST_ROWS = 8, 500_000
_random: dict[str, bytes] = {}

#: (type, pattern), in order of precedence where matches overlap. A group named x is what is replaced, else the match.
PATTERNS = (
    ("email", r"[A-Za-z0-9](?:[A-Za-z0-9._%+-]{0,62}[A-Za-z0-9_%+-])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"),
    ("secret", r"(?i:\b(?:token|api[_-]?key|secret|password|passwd|auth)\b[\"']?\s{0,3}[:=]\s{0,3})[\"']?(?P<x>[A-Za-z0-9_\-]{16,})"),
    ("secret", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b|\bgh[pousr]_[A-Za-z0-9]{36}\b"),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"),
    ("phone", r"(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-]|\.\d)"),
    ("name", r"\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\b\.? (?P<x>[A-ZÀ-ÖØ-Þ][\w'’-]+(?: [A-ZÀ-ÖØ-Þ][\w'’-]+){0,2})"),
    ("name", r"(?:г-н|г-жа|господин|госпожа) (?P<x>[А-ЯЁ][а-яё-]+(?: [А-ЯЁ][а-яё-]+){0,2})"),
)
_COMPILED = tuple((kind, re.compile(p)) for kind, p in PATTERNS)
#: What each pattern's matches hold at least, in the order of PATTERNS: without it the pattern needn't run on a text.
_HINTS = tuple(map(re.compile, (
    r"@",
    r"[:=]\s{0,3}[\"']?[A-Za-z0-9_\-]{16}",
    r"AKIA|ASIA|gh[pousr]_",
    r"[A-Z]{2}\d{2}",
    r"\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d",
    r"\d{3}-\d{2}-",
    r"\d\.\d",
    r"\+\d",
    r"\d{3}[) .-]",
    r"Mr|Ms|Miss|Dr|Prof|Herr|Frau|M[ao]|Mme|Se[ñn]or|Sra?",
    r"г-|госпо",
)))
_FEMALE = re.compile(r"(?:Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|г-жа|госпожа)\.? $")
_MALE = re.compile(r"(?:Mr|Herr|Monsieur|Señor|Sr|г-н|господин)\.? $")
#: Given names by script and gender ('f', 'm', and 'n' for unknown), and family names.
NAMES = {
    ("latin", "f"): "Alma Berta Clara Dora Edith Flora Greta Helga Irene Julia Karin Laura Maren Nora Olga Petra Rosa Sofia Tilda Vera".split(),
    ("latin", "m"): "Anton Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Max Nils Oskar Paul Rolf Simon Theo Viktor".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Зоя Ирина Ксения Лидия Мария Нина".split(),
    ("cyrillic", "m"): "Антон Борис Глеб Денис Егор Иван Кирилл Лев Максим Павел".split(),
    ("latin", ""): "Abel Adler Albers Becker Bender Brandt Conrad Daly Ebert Falk Garner Haas Hale Jansen Keller Lange Moreau Norden Olsen Parker Quist Reyes Stone Tanner Ulrich Vance Weber Yates Zeller".split(),
    ("cyrillic", ""): "Алексеенко Белых Громыко Долгих Коваленко Лысенко Морозенко Петренко Седых Черных".split(),
}


def find_entities(text: str | None) -> list[tuple[int, int, str, str]]:
    """(start, end, type, normalized form) of all entities, without overlaps, in text order."""
    if not text:
        return []
    found: list[tuple[int, int, str, str]] = []
    for hint, (kind, pattern) in zip(_HINTS, _COMPILED, strict=True):
        if not hint.search(text):
            continue
        for m in pattern.finditer(text):
            s, e = m.span("x") if "x" in pattern.groupindex else m.span()
            surface = text[s:e]
            if kind == "card" and not _luhn(surface) or kind == "iban" and not _iban(surface):
                continue
            _add(found, (s, e, kind, _normal(kind, surface, text[max(0, s - 12) : s])))
    # Whoever a title has shown to be a person is one without it too.
    full = sorted({n for _, _, kind, normal in found if kind == "name" and " " in (n := normal.split(":", 1)[1])}, key=len, reverse=True)
    if full:
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(r"\s+".join(map(re.escape, n.split())) for n in full) + r")(?!\w)", text):
            _add(found, (*m.span(), "name", _normal("name", m.group(), "")))
    return found


def _add(found: list[tuple[int, int, str, str]], entity: tuple[int, int, str, str]) -> None:
    """Puts ``entity`` in its place among the others, in text order, unless it overlaps one of them."""
    at = bisect(found, entity)
    if (at == 0 or found[at - 1][1] <= entity[0]) and (at == len(found) or entity[1] <= found[at][0]):
        found.insert(at, entity)


def _normal(kind: str, surface: str, before: str) -> str:
    if kind == "email":
        return surface.lower()
    if kind in ("card", "phone", "ssn"):
        return re.sub(r"[^\d+]", "", surface)
    if kind == "iban":
        return surface.replace(" ", "")
    if kind == "name":
        gender = "f" if _FEMALE.search(before) else "m" if _MALE.search(before) else "n"
        return f"{gender}:{' '.join(surface.split())}"
    return surface


def _luhn(s: str) -> bool:
    digits = [int(c) for c in s if c.isdigit()]
    return 13 <= len(digits) <= 19 and sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


class _Stream:
    """Numbers from a keyed hash of (type, normalized form, draw)."""

    def __init__(self, key: bytes, kind: str, normal: str, draw: int):
        self.key, self.name, self.block, self.pool = key, f"{kind}\x00{normal}\x00{draw}".encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool += hmac.new(self.key, self.name + self.block.to_bytes(4, "big"), hashlib.sha256).digest()
            self.block += 1
        x, self.pool = self.pool[:4], self.pool[4:]
        return int.from_bytes(x, "big") % n


def session_key(spark: SparkSession) -> bytes:
    """The session's secret (``KEY_SETTING``); where it has none, a random one for as long as the application runs."""
    given = spark.conf.get(KEY_SETTING, None)
    return given.encode() if given else _random.setdefault(spark.sparkContext.applicationId, secrets.token_bytes(32))


def surrogate(kind: str, normal: str, draw: int, key: bytes, domain_draw: int = 0) -> str:
    """The normalized form of the replacement of an entity; an e-mail address has its domain's replacement."""
    s = _Stream(key, kind, normal, draw)
    # Where short forms run out, later draws are longer: there is always room for one more.
    more = 0 if draw < LONGER_FROM else 1 + (draw - LONGER_FROM) // 2
    if kind == "name":
        gender, _, name = normal.partition(":")
        script = "cyrillic" if re.search("[А-Яа-яЁё]", name) else "latin"
        parts = name.split(" ")
        given = NAMES[script, gender if gender != "n" else "fm"[s.below(2)]]
        family = NAMES[script, ""]
        # A syllable more at each further draw keeps the pool from running out.
        tail = "" if draw == 0 else "".join("bcdfgklmnprst"[s.below(13)] + "aeiou"[s.below(5)] for _ in range(1 + draw // 8)) if script == "latin" else "".join("бвгдклмн"[s.below(8)] + "аеио"[s.below(4)] for _ in range(1 + draw // 8))
        out = [given[s.below(len(given))] for _ in parts[:-1]] + [family[s.below(len(family))] + tail]
        return f"{gender}:{' '.join(out)}"
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4 + more))
    if kind == "email":
        local, _, domain = normal.partition("@")
        return f"{_like(local + local[-1:] * more, s)}@{surrogate('domain', domain, domain_draw, key)}"
    if kind == "domain":
        labels = domain_labels(normal)
        labels[0] += "a" * more
        # The top level stays.
        return ".".join([_like(x, s) for x in labels[:-1]] + labels[-1:])
    if kind == "card":
        body = normal[0] + "".join(str(s.below(10)) for _ in normal[2:] + "0" * min(more, 19 - len(normal)))
        return next(body + c for c in "0123456789" if _luhn(body + c)) if len(normal) >= 13 else _like(normal, s)
    if kind == "iban":
        body = _like(normal[4:] + "0" * more, s)
        rest = int("".join(str(int(c, 36)) for c in f"{body}{normal[:2]}00")) % 97
        return f"{normal[:2]}{98 - rest:02d}{body}"
    if kind == "phone" and normal.startswith("+"):
        keep = max(2, len(normal) - 10)  # the country code
        return normal[:keep] + _like(normal[keep:] + "0" * more, s)
    return _like(normal + ("0" if normal[-1:].isdigit() else "a") * more, s)


def domain_labels(domain: str) -> list[str]:
    """The labels of a domain; one without a dot gets an empty top level."""
    labels = domain.split(".")
    return labels if len(labels) > 1 else [domain, ""]


def _like(text: str, s: _Stream) -> str:
    """Each digit, hexadecimal word and letter replaced by one of its kind."""
    hexadecimal = len(text) >= 16 and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text)
    out = []
    for c in text:
        if hexadecimal:
            out.append(("0123456789abcdef" if text == text.lower() else "0123456789ABCDEF")[s.below(16)])
        elif c.isdigit():
            out.append(str(s.below(10)))
        elif "a" <= c <= "z":
            out.append(chr(97 + s.below(26)))
        elif "A" <= c <= "Z":
            out.append(chr(65 + s.below(26)))
        else:
            out.append(c)
    return "".join(out)


def written(kind: str, surface: str, replacement: str) -> str:
    """The replacement in the form of ``surface``: its separators, and its case where only case was normalized."""
    if kind == "name":
        return replacement.partition(":")[2]
    if kind in ("card", "phone", "ssn", "iban"):
        chars = iter(replacement)
        return "".join(next(chars, "0") if c.isalnum() or c == "+" else c for c in surface) + "".join(chars)
    if kind == "email":
        return "".join(r.upper() if c.isupper() else r for c, r in zip(surface, replacement)) if len(surface) == len(replacement) else replacement
    return replacement


def _detect(with_entities: bool, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("normal", pa.string())]))
        for batch in batches:
            found = [find_entities(t) for t in batch.column("text").to_pylist()]
            take = pa.array([i for i, f in enumerate(found) if bool(f) is with_entities], pa.int64())
            columns = [batch.column(c).take(take) for c in keep]
            if with_entities:
                columns.append(pa.array([[dict(zip(("start", "end", "kind", "normal"), x)) for x in f] for f in found if f], kind))
            yield pa.RecordBatch.from_arrays(columns, names=keep + ["entities"] * with_entities)

    return run


def _draw(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = ["kind", "normal", "draw", "domain_draw"]
            made = [surrogate(k, n, d, key, x) for k, n, d, x in zip(*(batch.column(c).to_pylist() for c in names))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(made, pa.string())], names=[*names, "surrogate"])

    return run


def _entity(normal: str) -> Column:
    """What an entity looks like in a text: a name without the gender of its title."""
    return F.when(F.col("kind") == "name", F.substring_index(normal, ":", -1)).otherwise(F.col(normal))


def surrogate_table(entities: DataFrame, key: bytes | None = None) -> DataFrame:
    """``kind, normal`` (distinct) -> also ``surrogate``, distinct within a kind and none of them a real entity.

    A name is one entity whatever its titles: it has the gender that all titles with one agree on, else none. Names
    are compared as they are written, without gender. Domains of e-mail addresses are entities of their own, so that
    different ones stay different and addresses of one stay together.
    """
    key = key or session_key(entities.sparkSession)
    named = entities.select("kind", "normal", _entity("normal").alias("entity"))
    gender = F.when(F.col("kind") == "name", F.nullif(F.substring_index("normal", ":", 1), F.lit("n")))
    titles = named.groupBy("kind", "entity").agg(F.min(gender).alias("low"), F.max(gender).alias("high"))
    one = F.concat(F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("n"), F.lit(":"), F.col("entity"))
    single = titles.select("kind", F.when(F.col("kind") == "name", one).otherwise(F.col("entity")).alias("normal"))
    domain = F.when(F.col("kind") == "email", F.substring_index("normal", "@", -1))
    domains = single.where("kind = 'email'").select(F.lit("domain").alias("kind"), domain.alias("normal")).distinct()
    # Domains whose first draw was taken; the others need no lookup.
    later = materialize(_settled(domains.withColumn("domain_draw", F.lit(0)), key).where("draw > 0").select(F.col("normal").alias("domain"), F.col("draw").alias("domain_draw")))
    later = F.broadcast(later) if later.count() <= BROADCAST_ROWS else later
    single = single.withColumn("domain", domain).join(later, "domain", "left").select("kind", "normal", F.coalesce("domain_draw", F.lit(0)).alias("domain_draw"))
    drawn = _settled(single, key).select("kind", _entity("normal").alias("entity"), "surrogate")
    return named.join(drawn, ["kind", "entity"]).select("kind", "normal", "surrogate")


def _settled(single: DataFrame, key: bytes) -> DataFrame:
    """``kind, normal`` (distinct), ``domain_draw`` -> also ``draw, surrogate``, all surrogates of a kind different.

    In each round the drawn surrogates are grouped; of equal ones the first draw, then the smallest entity, stays, and
    the rest, and whatever equals an entity that occurs, draw again. Rounds after the first see only those, and
    surrogates get longer with the rounds, so the last one always comes.
    """
    real = single.select("kind", _entity("normal").alias("shown")).withColumn("taken", F.lit(1))
    schema = "kind string, normal string, draw int, domain_draw int, surrogate string"
    table = materialize(single.withColumn("draw", F.lit(0)).mapInArrow(_draw(key), schema))
    while True:
        same = Window.partitionBy("kind", "shown").orderBy("draw", "normal")
        judged = table.withColumn("shown", _entity("surrogate")).join(real, ["kind", "shown"], "left").withColumn("place", F.row_number().over(same))
        again = materialize(judged.where("place > 1 or taken is not null").select("kind", "normal", "draw", "domain_draw"))
        if again.isEmpty():
            return table
        redrawn = again.withColumn("draw", F.col("draw") + 1).mapInArrow(_draw(key), schema)
        table = materialize(table.join(again.select("kind", "normal"), ["kind", "normal"], "left_anti").unionByName(redrawn))


def _rewrite(keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, counts = [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                parts, at = [], 0
                for x in sorted(spans, key=lambda x: x["start"]):
                    parts += [text[at : x["start"]], written(x["kind"], text[x["start"] : x["end"]], x["surrogate"])]
                    at = x["end"]
                out.append("".join([*parts, text[at:]]))
                counts.append(len(spans))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(out, pa.string()), pa.array(counts, pa.int32())], names=[*keep, "text", "n_entities"])

    return run


def replace_personal_data(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """``docs`` (text and any other columns) with every entity in ``text`` replaced, and ``n_entities`` (int).

    Surrogates are drawn from ``key``; without one from the session's (``session_key``). A full name that a title has
    shown to be a person's is replaced wherever it stands in that text.

    Null and empty texts and texts without entities come back unchanged with 0. Repeated rows are all rewritten,
    alike. Other columns are kept; ``n_entities`` and underscored working columns of that name are replaced.
    ``docs`` must give the same rows on every read, as files do.
    """
    docs = docs.drop("n_entities", "entities", "spans", "_row")
    names = [c for c in docs.columns if c != "text"]
    types = {f.name: f.dataType.simpleString() for f in docs.schema}
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    columns = ", ".join(f"`{c}` {types[c]}" for c in [*names, "text"])
    # The numbers of the rows with entities are written once, with all their columns.
    found = rows.mapInArrow(_detect(True, ["_row", *names, "text"]), f"_row bigint, {columns}, entities array<struct<start:int,end:int,kind:string,normal:string>>")
    found = materialize(found)
    each = found.select("_row", F.explode("entities").alias("e")).select("_row", "e.*")
    table = surrogate_table(each.select("kind", "normal").distinct(), key)
    spans = each.join(table, ["kind", "normal"]).groupBy("_row").agg(F.collect_list(F.struct("start", "end", "kind", "surrogate")).alias("spans"))
    rewritten = found.select("_row", "text").join(spans, "_row").mapInArrow(_rewrite(["_row"]), "_row bigint, text string, n_entities int")
    others = found.drop("text", "entities").join(rewritten, "_row").select(*names, "text", "n_entities")
    clean = docs.mapInArrow(_detect(False, [*names, "text"]), columns).withColumn("n_entities", F.lit(0))
    return others.unionByName(clean).select(*docs.columns, "n_entities")


def op3_pii(spark, sf_dir: str) -> DataFrame:
    """All ``documents`` with surrogates for their personal data."""
    return replace_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
