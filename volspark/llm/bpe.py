"""Byte-level BPE as relational queries: each task contracts the distinct words of its texts in DuckDB."""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import released, text_bytes

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Bytes of text whose words are contracted together, and rows that one query starts from.
CHUNK, ROWS = 1 << 23, 200_000
REMEMBERED = 150_000
#: No contraction of the pattern begins with one of these.
MARKS = (".", ",", ";", ":", "!", "?")
#: Longer words contract all equal pairs of a step that cannot touch each other's order.
LONG = 48

#: One step of every open word: the leftmost pair of least rank becomes one token. A row knows the token after it and the pair's rank, so
#: a step needs the least (rank, place) of each word, and the merge table only for the two pairs that change.
SHORT_STEP = """
with recursive state(word, step, pos, tok, next_pos, next_tok, rank) as (
    select s.word, 0, s.pos, s.tok, s.next_pos, s.next_tok, m.rank
    from (select *, lead(pos) over w as next_pos, lead(tok) over w as next_tok from start window w as (partition by word order by pos)) s
    left join merges m on m.a = s.tok and m.b = s.next_tok
    union all
    select n.word, n.step, n.pos, n.tok, n.next_pos, n.next_tok, case when n.fresh then m.rank else n.rank end
    from (
        select s.word, s.step + 1 as step, s.pos, s.rank,
               case when s.pos = b.spot then b.best else s.tok end as tok,
               case when s.pos = b.spot then b.after_pos else s.next_pos end as next_pos,
               case when s.pos = b.spot then b.after_tok when s.next_pos = b.spot then b.best else s.next_tok end as next_tok,
               s.pos = b.spot or coalesce(s.next_pos = b.spot, false) as fresh
        from state s join (
            select c.word, c.best, c.spot, c.gone, r.next_pos as after_pos, r.next_tok as after_tok
            from (
                select word, cast(k >> 16 as int) as best, cast((k >> 8) & 255 as int) as spot, cast(k & 255 as int) as gone
                from (select word, min((cast(rank as bigint) << 16) | (pos << 8) | next_pos) as k from state where rank is not null group by word)
            ) c join state r on r.word = c.word and r.pos = c.gone
        ) b on b.word = s.word
        where s.pos <> b.gone
    ) n left join merges m on m.a = case when n.fresh then n.tok end and m.b = n.next_tok
)
select s.word, s.pos, s.tok from state s join (select word, max(step) as last from state group by word) e on e.word = s.word and e.last = s.step
"""

#: Rows of all steps that one query over long words keeps at most; what is left open goes into the next one.
KEPT = 2_000_000
#: The same for long words: if no pair made with the new token outranks it, all equal pairs go at once, of overlapping ones the first.
LONG_STEP = """
with recursive state(word, step, pos, tok, next_pos, next_tok, rank) as (
    select s.word, 0, s.pos, s.tok, s.next_pos, s.next_tok, m.rank
    from (select *, lead(pos) over w as next_pos, lead(tok) over w as next_tok from start window w as (partition by word order by pos)) s
    left join merges m on m.a = s.tok and m.b = s.next_tok
    union all (
        with open as (select word, min(rank) as best from state where rank is not null and step < {STEPS} group by word),
        hits as (
            select *, sum(case when touches then 0 else 1 end) over (partition by word order by pos) as island, row_number() over (partition by word order by pos) as place
            from (
                select s.word, s.pos, s.next_pos, o.best, o.best not in (select tok from unsafe) as safe,
                       coalesce(lag(s.next_pos) over (partition by s.word order by s.pos) = s.pos, false) as touches
                from state s join open o on o.word = s.word and o.best = s.rank
            )
        ),
        takes as materialized (
            select h.word, h.pos as spot, h.next_pos as gone, h.best, r.next_pos as after_pos, r.next_tok as after_tok
            from (select *, min(place) over (partition by word, island) as head from hits) h
            join state r on r.word = h.word and r.pos = h.next_pos
            where case when h.safe then (h.place - h.head) % 2 = 0 else h.place = 1 end
        ),
        kept as (
            select s.word, s.step + 1 as step, s.pos, s.rank, coalesce(t.best, s.tok) as tok, t.best is not null as merged,
                   case when t.best is not null then t.after_pos else s.next_pos end as next_pos,
                   case when t.best is not null then t.after_tok else s.next_tok end as next_tok
            from state s join open o on o.word = s.word
            left join takes t on t.word = s.word and t.spot = s.pos
            left join takes g on g.word = s.word and g.gone = s.pos
            where g.word is null
        ),
        moved as (
            select k.word, k.step, k.pos, k.rank, k.tok, k.next_pos, coalesce(u.best, k.next_tok) as next_tok, k.merged or u.best is not null as fresh
            from kept k left join takes u on u.word = k.word and u.spot = k.next_pos
        )
        select n.word, n.step, n.pos, n.tok, n.next_pos, n.next_tok, case when n.fresh then m.rank else n.rank end
        from moved n left join merges m on m.a = case when n.fresh then n.tok end and m.b = n.next_tok
    )
)
select s.word, s.pos, s.tok from state s join (select word, max(step) as last from state group by word) e on e.word = s.word and e.last = s.step
"""

#: Words that still have a pair to merge.
OPEN = """
select count(*) from (select tok, lead(tok) over (partition by word order by pos) as next_tok from tokens) t
join merges m on m.a = t.tok and m.b = t.next_tok
"""

#: The bytes that each word's tokens stand for, in their order.
DECODE = "select t.word, string_agg(p.hex, '' order by t.pos) as hex from tokens t join pieces p on p.tok = t.tok group by t.word"


@cache
def ranks(name: str) -> dict[bytes, int]:
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_rows(vocabulary: dict[bytes, int]) -> tuple[pa.Table, pa.Table]:
    """(a, b, rank): token pairs whose bytes together are a token; (tok): tokens of which some pair has a lower rank than they."""
    a, b, rank = [], [], []
    for token, r in vocabulary.items():
        for cut in range(1, len(token)):
            left, right = vocabulary.get(token[:cut]), vocabulary.get(token[cut:])
            if left is not None and right is not None:
                a.append(left), b.append(right), rank.append(r)
    a, b, rank = (np.array(x, np.int32) for x in (a, b, rank))
    return pa.table({"a": a, "b": b, "rank": rank}), pa.table({"tok": np.union1d(a[rank < a], b[rank < b])})


@cache
def _engine(name: str):
    """A connection of this process with the tables merges, unsafe and pieces."""
    import duckdb

    con = duckdb.connect()
    con.execute("set threads = 1")
    con.execute("set memory_limit = '400MB'")
    con.execute("set temp_directory = ''")  # nothing is written beside the worker; a group of words is bounded by ROWS
    vocabulary = ranks(name)
    merges, unsafe = merge_rows(vocabulary)
    pieces = pa.table({"tok": pa.array(list(vocabulary.values()), pa.int32()), "bytes": pa.array(list(vocabulary), pa.binary()), "hex": [t.hex() for t in vocabulary]})
    for table, rows in (("merges", merges), ("unsafe", unsafe), ("pieces", pieces)):
        con.register("given", rows)
        con.execute(f"create table {table} as select * from given")
        con.unregister("given")
    return con


#: Words that are tokens: the library looks for these first, and so they start as one row.
WHOLE = "select w.word, p.tok from words w join pieces p on p.bytes = w.bytes"


def _contract(con, words: list[bytes], single: np.ndarray, query: str) -> list[tuple[str, bytes]]:
    """(ids joined by commas, decoded bytes) of each word."""
    con.register("words", pa.table({"word": np.arange(len(words), dtype=np.int32), "bytes": pa.array(words, pa.binary())}))
    whole = con.execute(WHOLE).fetchnumpy()
    con.unregister("words")
    sizes = np.array([len(w) for w in words], np.int64)
    at = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    pos = (np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
    letter = np.ones(len(words), bool)
    letter[whole["word"]] = False
    rows = letter[at]
    start = {
        "word": np.concatenate((at[rows], whole["word"].astype(np.int32))), "pos": np.concatenate((pos[rows], np.zeros(len(whole["word"]), np.int32))),
        "tok": np.concatenate((single[np.frombuffer(b"".join(words), np.uint8)][rows], whole["tok"].astype(np.int32))),
    }
    con.register("start", pa.table(start))
    once = "create or replace temp table tokens as " + query.replace("{STEPS}", str(min(256, max(4, KEPT // max(1, len(start["pos"]))))))
    con.execute(once)
    con.unregister("start")
    while query is LONG_STEP and con.execute(OPEN).fetchone()[0]:
        con.execute("create or replace temp table start as select * from tokens")
        con.execute(once)
        con.execute("drop table start")
    got = con.execute("select word, tok from tokens order by word, pos").fetchnumpy()
    ends = np.cumsum(np.bincount(got["word"], minlength=len(words))).tolist()
    ids = list(map(str, got["tok"].tolist()))
    joined = [",".join(ids[a:z]) for a, z in zip([0, *ends[:-1]], ends, strict=True)]
    out: list = [None] * len(words)
    for word, text in con.execute(DECODE).fetchall():
        text = bytes.fromhex(text)
        out[word] = (joined[word], words[word] if text == words[word] else text)  # one object for equal bytes
    return out


def encode_words(words: list[bytes], name: str) -> dict[bytes, tuple[str, bytes]]:
    """(ids joined by commas, decoded bytes) of each distinct word, by queries over at most ROWS bytes or one word.

    Words of up to LONG bytes take one step a merge. A longer word would take thousands and takes all equal pairs of a step
    at once, with the same result: its steps still grow with its length, so words of some ten thousand letters are slow.
    """
    con, vocabulary = _engine(name), ranks(name)
    single = np.array([vocabulary[bytes([i])] for i in range(256)], np.int32)
    found: dict[bytes, tuple[str, bytes]] = {}
    for query, some in ((SHORT_STEP, [w for w in words if len(w) <= LONG]), (LONG_STEP, [w for w in words if len(w) > LONG])):
        part, size = [], 0
        for w in [*some, None]:
            if part and (w is None or size + len(w) > ROWS):
                found.update(zip(part, _contract(con, part, single, query), strict=True))
                part, size = [], 0
            if w is not None:
                part.append(w)
                size += len(w)
    return found


@cache
def splitter(pattern: str):
    """findall of the pattern with its classes written out for the standard library.

    The classes' code points are asked of the library that the pattern is written for.
    """
    import re

    import regex

    everything = np.concatenate((np.arange(0xD800), np.arange(0xE000, 0x110000))).astype("<u4").tobytes().decode("utf-32-le")  # without an object for each
    spans = {c: "".join(f"{re.escape(m[0])}-{re.escape(m[-1])}" for m in regex.findall(rf"{c}+", everything)) for c in (r"\p{L}", r"\p{N}", r"\s")}
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", "[^" + spans[r"\s"] + spans[r"\p{L}"] + spans[r"\p{N}"] + "]").replace(r"(?!\S)", f"(?![^{spans[r'\s']}])")
    for c in spans:
        plain = plain.replace(c, f"[{spans[c]}]")
    return re.compile(plain).findall


#: White space that touches other white space, or is neither a space nor a newline.
_RUNS = None


def chunks(text: str) -> list[str] | None:
    """The text cut before its spaces, if no match of the pattern crosses such a cut; else None.

    A match holds a space only in front of it or in a run of white space. Where single spaces stand between other
    characters, those behind a space start a match.
    """
    global _RUNS
    if _RUNS is None:
        import re

        odd = "\t\v\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
        _RUNS = re.compile(f"[{odd}]|  |\n | \n|^ | $").search
    return None if _RUNS(text) else text.split(" ")


def words_of(piece: str, split) -> list[bytes]:
    """The matches of the pattern in a piece; letters behind at most one space, with at most one mark after them, need no search."""
    letters = piece[:-1] if piece[-1:] in MARKS else piece
    if letters[1:].isalpha() and (letters[0] == " " or letters[0].isalpha()):
        return [piece.encode()] if letters is piece else [letters.encode(), piece[-1].encode()]
    return [w.encode() for w in split(piece)]


#: Words that a worker process remembers between texts and tasks.
_KNOWN: dict[str, dict[bytes, tuple[str, bytes]]] = {}


def _codes(words: set[bytes], name: str) -> dict[bytes, tuple[str, bytes]]:
    known = _KNOWN.setdefault(name, {})
    found = encode_words([w for w in words if w not in known], name)
    for w in list(found)[: max(0, REMEMBERED - len(known))]:
        known[w] = found[w]
    return {w: known[w] if w in known else found[w] for w in words}


def _encode(batches, name: str):
    """The columns before the last one, then n_tokens, ids_sha256, decoded of its texts."""
    import public_tokenizers

    released()
    split = splitter(public_tokenizers.PATTERN)
    for b in batches:
        texts, at = b.column(b.num_columns - 1), 0
        while at < b.num_rows:
            n_tokens, digests, decoded, first = [], [], [], at
            place: dict[str, int] = {}  # of pieces of text, " word," or a whole text with odd white space
            docs, size = [], 0
            while at < b.num_rows and size < CHUNK:
                raw = texts[at].as_py()
                text = raw.decode("utf-8", "replace")
                parts = chunks(text)
                if parts is None:
                    parts = split(text)
                elif len(parts) > 1:
                    parts = [parts[0], *map(" ".__add__, parts[1:])]
                docs.append(np.array([place.setdefault(p, len(place)) for p in parts], np.int32))
                size += len(raw)
                at += 1
            pieces = [words_of(p, split) for p in place]
            codes = _codes({w for p in pieces for w in p}, name)
            both = [codes[p[0]] if len(p) == 1 else (",".join([codes[w][0] for w in p]), b"".join([codes[w][1] for w in p])) for p in pieces]
            ids, text = [x[0] for x in both], [x[1] for x in both]
            del place, codes, pieces, both
            count = np.array([x.count(",") + 1 if x else 0 for x in ids], np.int64)
            for own in docs:
                n_tokens.append(int(count[own].sum()))
                own = own.tolist()
                digests.append(hashlib.sha256(",".join(filter(None, map(ids.__getitem__, own))).encode()).hexdigest())
                decoded.append(b"".join(map(text.__getitem__, own)))
            own = [b.column(i).slice(first, at - first) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(n_tokens, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.binary())], [*b.schema.names[:-1], "n_tokens", "ids_sha256", "decoded"])


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, keep: list[str] = ("doc_id",)) -> DataFrame:
    """(keep, n_tokens, ids_sha256, decoded) of every row of docs; null texts are empty and have no tokens, null ids and repeated
    rows stay, other columns are ignored.

    Texts are split by the vocabulary's pattern; the distinct words of some megabytes of texts are contracted at once, and
    all of them are looked up, merged and decoded in DuckDB. A task remembers words it has met.
    """
    rows = docs.select(*keep, text_bytes().alias("__text"))
    schema = rows.drop("__text").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded", "binary")
    return rows.mapInArrow(lambda it: _encode(it, vocabulary), schema)


def encode_digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return round_trip(rows, vocabulary).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
