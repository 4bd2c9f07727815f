"""Hash chains over record tables: sealing, links, heads, verification.

Chain rows: run_id, chain, seq, record_id, head, prev_hash, mac, where `head` is
the canonical text before prev_hash, NULL where the record holds a value that
cannot be written. A chain is one (run_id, chain), however long. Sealing is
sequential by nature and streams with one hash of state; checking is parallel:
every record is hashed under its own stored prev_hash.
"""

from __future__ import annotations

import hashlib
import hmac as hmac_lib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runaudit import vocab as V
from runaudit.functions import canonical as K
from runaudit.functions import scalars as S
from runaudit.operators.scan import Scan, dealt, durable, number_rows, running

CHAIN = ("run_id", "chain")
ID = {"Declaration": "declaration_id", "Verdict": "verdict_id"}
CHAIN_OF = {"Declaration": "policy", "Verdict": "enforcement"}


def _frame(name: str, value: str) -> str:
    sep = K.FIELD_SEP
    return f"{name}{sep}s{sep}{len(value.encode())}{sep}{value}{K.RECORD_SEP}"


def seal(records: DataFrame, kind: str, key: bytes, fmt: K.Format = K.Format()) -> DataFrame:
    """Link and sign records in (seq, id) order (H5).

    Each record's hash needs the one before, so a chain is a stream through
    one sorted partition with a single hash of state; batches are never
    gathered. A record without a head gets neither link nor MAC, and the next one
    starts from genesis, as checking expects.
    """
    link, record, signing = fmt.domain(K.LINK), fmt.domain(K.RECORD), fmt.domain(K.SIGNING)
    rid = ID[kind]
    # heads are written after the exchange, so that only the fields themselves are moved and sorted
    rows = records.repartition("run_id").sortWithinPartitions("run_id", "seq", rid).withColumn("_head", K.head(kind))
    schema = T.StructType(
        [f for f in rows.schema.fields if f.name != "_head"]
        + [T.StructField("prev_hash", T.StringType()), T.StructField("mac", T.StringType())]
    )

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, prev = None, V.GENESIS
        for batch in batches:
            prevs, macs = [], []
            for r, head in zip(batch.column("run_id").to_pylist(), batch.column("_head").to_pylist()):
                if at != r:
                    at, prev = r, V.GENESIS
                if head is None:
                    prevs.append(None)
                    macs.append(None)
                    prev = V.GENESIS
                    continue
                body = (head + _frame("prev_hash", prev)).encode()
                mac = hmac_lib.digest(key, signing + body, "sha256").hex()
                prevs.append(prev)
                macs.append(mac)
                prev = hashlib.sha256(
                    link + bytes.fromhex(prev) + record + body + _frame("mac", mac).encode()
                ).hexdigest()
            keep = [c for c in batch.schema.names if c != "_head"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(prevs, pa.string()), pa.array(macs, pa.string())],
                names=[*keep, "prev_hash", "mac"],
            )

    return rows.mapInArrow(fold, schema)


def stored_seal(records: DataFrame, kind: str, key: bytes, fmt: K.Format = K.Format()) -> DataFrame:
    """`seal`, stored. Links and MACs just made are well formed or NULL, so they are stored as bytes."""
    out = seal(records, kind, key, fmt)
    kept = durable(out.withColumns({c: F.unhex(c) for c in ("prev_hash", "mac")}))
    return kept.withColumns({c: S.to_hash(F.col(c)) for c in ("prev_hash", "mac")})


def chain_rows(records: DataFrame, kind: str, *also: str) -> DataFrame:
    return records.select(
        "run_id", F.lit(CHAIN_OF[kind]).alias("chain"), "seq",
        F.col(ID[kind]).alias("record_id"), K.head(kind).alias("head"), "prev_hash", "mac", *also,
    )


def _hashed(rows: DataFrame, keys: dict[str, bytes] | None, fmt: K.Format) -> DataFrame:
    """Row-local hash and MAC state of every record; the record text ends here,
    so what is ordered and shuffled afterwards is narrow."""
    state = F.lit(V.MAC_CNE)
    for chain, key in (keys or {}).items():
        state = F.when(
            F.col("chain") == chain,
            K.mac_state(fmt, key, F.col("head"), F.col("prev_hash"), F.col("mac")),
        ).otherwise(state)
    return rows.select(
        *CHAIN, "seq", "record_id", "prev_hash",
        K.chain_hash(fmt, F.col("head"), F.col("prev_hash"), F.col("mac")).alias("own_hash"),
        state.alias("mac_state"),
    )


def checked(
    rows: DataFrame, keys: dict[str, bytes] | None, fmt: K.Format = K.Format(),
    chunk_rows: int = V.CHUNK_ROWS,
) -> DataFrame:
    """Each record beside the hash its predecessor has, and its MAC
    state; keys by chain, or None. NULL own_hash marks a record that cannot be
    hashed; its successor then expects genesis. Hashes are stored once, since
    the ordered pass reads them twice, and as bytes; a prev_hash that is none stays as it is."""
    stored = durable(
        _hashed(rows, keys, fmt).select(
            *CHAIN, "seq", "record_id", "mac_state", S.from_hash(F.col("prev_hash")).alias("_prev"),
            F.when(S.from_hash(F.col("prev_hash")).isNull(), F.col("prev_hash")).alias("_odd"), F.unhex("own_hash").alias("_own"),
        )
    )
    h = stored.withColumn("chunk", F.floor(F.col("seq") / chunk_rows).cast("long"))
    j = running(
        h, CHAIN, "chunk", ["seq", "record_id"],
        [Scan("_before", "lag", F.struct("record_id", "_own"))],
    )
    j = j.select(
        *CHAIN, "seq", "record_id", "mac_state", S.to_hash(F.col("_own")).alias("own_hash"),
        F.coalesce(S.to_hash(F.col("_prev")), F.col("_odd")).alias("prev_hash"),
        F.when(
            F.col("_before").isNotNull(),
            F.struct(F.col("_before.record_id").alias("record_id"), S.to_hash(F.col("_before._own")).alias("own_hash")),
        ).alias("_pred"),
    )
    expected = F.coalesce(F.col("_pred.own_hash"), F.lit(V.GENESIS))
    return j.select(
        *CHAIN, "seq", "record_id", "prev_hash", "own_hash", "mac_state",
        F.col("_pred.record_id").alias("predecessor_id"), expected.alias("expected"),
        F.when(F.col("prev_hash").eqNullSafe(expected), F.lit("ok"))
        .when(F.col("_pred").isNull(), F.lit("genesis"))
        .otherwise(F.lit("link"))
        .alias("link"),
    )


def checked_in_place(
    rows: DataFrame, keys: dict[str, bytes] | None, fmt: K.Format = K.Format(), beside: bool = False
) -> DataFrame:
    """`checked` of rows as `seal` leaves them: a chain whole in one partition and in order. Each record
    then meets its predecessor where it lies, with one hash of state, and neither a record nor
    a hash is stored or moved. Says nothing of the predecessor but whether the link holds, unless its
    name and the expected hash are asked for `beside` it."""
    h = _hashed(rows, keys, fmt)
    said = [*CHAIN, "seq", "record_id", "mac_state"]
    names = [*said, "own_hash", "link", *(("predecessor_id", "expected") if beside else ())]
    schema = T.StructType([h.schema[c] for c in said] + [T.StructField(c, T.StringType()) for c in names[len(said):]])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (*CHAIN, "own_hash", "record_id")
        at = (None,) * len(held)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            # a column beside itself, one row back; the first row is beside the last of the batch before
            back = [
                pa.concat_arrays([pa.array([e], c.type), c.slice(0, n - 1)])
                for e, c in zip(at, [batch.column(c) for c in held])
            ]
            same = pc.fill_null(pc.and_(*[pc.equal(a, batch.column(c)) for a, c in zip(back, CHAIN)]), False)
            expected = pc.fill_null(pc.if_else(same, back[2], V.GENESIS), V.GENESIS)
            ok = pc.fill_null(pc.equal(batch.column("prev_hash"), expected), False)
            state = pc.if_else(ok, "ok", pc.if_else(same, "link", "genesis"))
            more = [pc.if_else(same, back[3], pa.scalar(None, back[3].type)), expected] if beside else []
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in (*said, "own_hash")] + [c.cast(pa.string()) for c in (state, *more)], names=names
            )
            at = tuple(batch.column(c)[n - 1].as_py() for c in held)

    return h.mapInArrow(walk, schema)


def links(rows: DataFrame, fmt: K.Format = K.Format(), chunk_rows: int = V.CHUNK_ROWS) -> DataFrame:
    """Links alone, with no key at hand."""
    return checked(rows, None, fmt, chunk_rows).drop("mac_state")


def _record_failures(c: DataFrame, have_keys: bool) -> DataFrame:
    bad, cne = F.lit(V.BROKEN), F.lit(V.CNE)

    def item(kind, state):
        return F.struct(F.lit(kind).alias("kind"), state.alias("state"))

    found = [
        F.when(F.col("link") == "link", item("link", bad)),
        F.when(F.col("link") == "genesis", item("genesis", bad)),
        F.when(F.col("own_hash").isNull(), item("unreadable", cne)),
    ]
    if have_keys:
        found += [
            F.when(F.col("mac_state") == V.MAC_INVALID, item("mac", bad)),
            F.when(F.col("mac_state") == V.MAC_CNE, item("mac", cne)),
        ]
    return c.select(
        "run_id", "chain", "record_id", "seq", F.explode(F.array_compact(F.array(*found))).alias("f")
    ).select("run_id", "chain", "f.kind", "f.state", "record_id", "seq")


def _per_chain(runs, c, stated, dangling, keys):
    """One row per run and chain with everything the roll-up needs."""
    every = runs.select(
        "run_id", "attestation_records", F.explode(F.array(*[F.lit(x) for x in V.CHAINS])).alias("chain")
    )
    n = c.groupBy("run_id", "chain").agg(
        F.count(F.lit(1)).alias("records"),
        F.count(F.when(F.col("mac_state") != V.MAC_CNE, 1)).alias("macs"),
        F.count(
            F.when((F.col("link") != "ok") | (F.col("mac_state") == V.MAC_INVALID), 1)
        ).alias("broken"),
        F.count(
            F.when(
                F.col("own_hash").isNull() | (F.lit(keys is not None) & (F.col("mac_state") == V.MAC_CNE)), 1
            )
        ).alias("unchecked"),
    )
    d = dangling.groupBy("run_id", "chain").agg(F.count(F.lit(1)).alias("dangling"))
    return (
        every.join(dealt(stated), ["run_id", "chain"], "left")
        .join(dealt(n), ["run_id", "chain"], "left")
        .join(dealt(d), ["run_id", "chain"], "left")
        .withColumn("present", F.coalesce(F.col("attestation_records") == V.RECORDS_PRESENT, F.lit(False)))
    )


def verify_chain(
    runs: DataFrame, rows: DataFrame | None, stated: DataFrame, dangling: DataFrame,
    keys: dict[str, bytes] | None, fmt: K.Format = K.Format(), verified: DataFrame | None = None,
) -> DataFrame:
    """H6, one row per run and chain. `stated` is (run_id, chain, stated)."""
    c = checked(rows, keys, fmt) if verified is None else verified
    p = _per_chain(runs, c, stated, dangling, keys)
    zero = F.lit(0).cast("long")
    records = F.coalesce(F.col("records"), zero)
    walked = F.col("present") & (records > 0)
    broken = walked & (
        (F.col("broken") > 0)
        | (F.coalesce(F.col("dangling"), zero) > 0)
        | (F.col("stated").isNotNull() & (F.col("stated") != records))
    )
    cne = ~F.col("present") | (records == 0) | F.col("stated").isNull() | (F.col("unchecked") > 0)
    if keys is None:
        cne = F.lit(True)
    return p.select(
        "run_id", "chain",
        F.when(broken, F.lit(V.BROKEN)).when(cne, F.lit(V.CNE)).otherwise(F.lit(V.VERIFIED)).alias("state"),
        F.when(walked, records).otherwise(zero).alias("records_walked"),
        F.when(walked, records).otherwise(zero).alias("links_checked"),
        F.when(walked, F.col("macs")).otherwise(zero).alias("macs_checked"),
        F.when(F.col("present"), F.col("stated")).alias("stated_records"),
    )


def chain_failures(
    runs: DataFrame, rows: DataFrame | None, stated: DataFrame, dangling: DataFrame,
    keys: dict[str, bytes] | None, fmt: K.Format = K.Format(), verified: DataFrame | None = None,
) -> DataFrame:
    """Every reason a chain is not VERIFIED, one row each."""
    c = checked(rows, keys, fmt) if verified is None else verified
    p = _per_chain(runs, c, stated, dangling, keys)
    zero = F.lit(0).cast("long")
    records = F.coalesce(F.col("records"), zero)
    present = F.col("present")

    def item(cond, kind, state):
        return F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(state).alias("state")))

    per_chain = p.select(
        "run_id", "chain",
        F.explode(
            F.array_compact(
                F.array(
                    item(~present, "no-record-stream", V.CNE),
                    item(present & F.col("stated").isNull(), "no-count", V.CNE),
                    item(present & (records == 0), "no-records", V.CNE),
                    item(present & (records > 0) & F.lit(keys is None), "no-key", V.CNE),
                    item(
                        present & (records > 0) & F.col("stated").isNotNull() & (F.col("stated") != records),
                        "count", V.BROKEN,
                    ),
                )
            )
        ).alias("f"),
    ).select(
        "run_id", "chain", "f.kind", "f.state", F.lit(None).cast("string").alias("record_id"),
        F.lit(None).cast("long").alias("seq"),
    )
    live = p.filter(present & (records > 0)).select("run_id", "chain")
    detail = _record_failures(c, keys is not None).join(
        runs.filter(F.col("attestation_records") == V.RECORDS_PRESENT).select("run_id"), "run_id", "left_semi"
    )
    gone = dangling.select(
        "run_id", "chain", F.lit("dangling-link").alias("kind"), F.lit(V.BROKEN).alias("state"),
        "record_id", F.lit(None).cast("long").alias("seq"),
    ).join(live, ["run_id", "chain"], "left_semi")
    return per_chain.unionByName(detail).unionByName(gone)


def chain_state(per_chain: DataFrame) -> DataFrame:
    """One state per run; BROKEN outweighs, nothing checked is unchecked."""
    return per_chain.groupBy("run_id").agg(
        S.worst_state(F.col("state"), V.BROKEN, V.VERIFIED).alias("state"),
        F.sum("records_walked").alias("records_walked"),
    )


def chain_heads(rows: DataFrame, fmt: K.Format = K.Format()) -> DataFrame:
    """H3: the fold from genesis that ignores stored prev_hash.

    Where every link of a chain holds, the fold equals the last record's own
    hash, so the head is an aggregate. Only broken chains are folded in order,
    streamed through sorted partitions with one hash of state.
    """
    g = links(rows, fmt).groupBy(*CHAIN).agg(
        F.count(F.when((F.col("link") != "ok") | F.col("own_hash").isNull(), 1)).alias("breaks"),
        F.max(F.struct("seq", "record_id", "own_hash")).alias("_last"),
    )
    intact = g.filter("breaks = 0").select(*CHAIN, F.col("_last.own_hash").alias("chain_head"))
    broken = rows.join(g.filter("breaks > 0").select(*CHAIN), list(CHAIN), "left_semi")
    return intact.unionByName(fold_heads(broken, fmt))


def fold_heads(rows: DataFrame, fmt: K.Format = K.Format()) -> DataFrame:
    text = K.canonical_text(F.col("head"), F.col("prev_hash"), F.col("mac"))
    ordered = (
        rows.select(*CHAIN, "seq", "record_id", text.alias("_text"))
        .repartition(*CHAIN)
        .sortWithinPartitions(*CHAIN, "seq", "record_id")
    )
    return _folded(ordered, CHAIN, fmt)


def heads_in_place(rows: DataFrame, also: tuple[str, ...] = (), fmt: K.Format = K.Format()) -> DataFrame:
    """`chain_heads` of rows as `seal` leaves them: a chain whole in one partition and in order, so that it is folded
    where it lies and no record or hash is stored or moved. Copies of a chain, told apart by `also`, may lie
    between each other."""
    keys = (*CHAIN, *also)
    text = K.canonical_text(F.col("head"), F.col("prev_hash"), F.col("mac"))
    return _folded(rows.select(*keys, text.alias("_text")), keys, fmt)


def _folded(ordered: DataFrame, keys: tuple[str, ...], fmt: K.Format) -> DataFrame:
    """The head of every chain of rows in order, with a hash of state for each copy of one chain."""
    link, record, genesis = fmt.domain(K.LINK), fmt.domain(K.RECORD), bytes.fromhex(V.GENESIS)
    schema = T.StructType([ordered.schema[c] for c in keys] + [T.StructField("chain_head", T.StringType())])
    n = len(CHAIN)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads, kinds = None, {}, None
        ended: list[tuple] = []

        def told(rows):
            cols = list(zip(*rows)) or [[] for _ in range(len(keys) + 1)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[*keys, "chain_head"])

        for batch in batches:
            kinds = [batch.schema.field(c).type for c in keys] + [pa.string()]
            cols = [batch.column(c).to_pylist() for c in keys]
            for *key, text in zip(*cols, batch.column("_text").to_pylist()):
                if key[:n] != at:
                    ended += [(*k, h.hex()) for k, h in heads.items()]
                    at, heads = key[:n], {}
                key = tuple(key)
                # a record that cannot be written starts its chain anew
                heads[key] = genesis if text is None else hashlib.sha256(
                    link + heads.get(key, genesis) + record + text.encode()
                ).digest()
            yield told(ended)
            ended = []
        if heads:
            yield told([(*k, h.hex()) for k, h in heads.items()])

    return ordered.mapInArrow(fold, schema)


def heads_by_run(heads: DataFrame) -> DataFrame:
    """Both heads of a run side by side; an empty chain's head is genesis."""
    pick = {c: F.max(F.when(F.col("chain") == c, F.col("chain_head"))) for c in V.CHAINS}
    return heads.groupBy("run_id").agg(
        F.coalesce(pick["policy"], F.lit(V.GENESIS)).alias("declaration_head"),
        F.coalesce(pick["enforcement"], F.lit(V.GENESIS)).alias("verdict_head"),
    )


def commit_heads(
    heads: DataFrame, witness_id: str, key: bytes, fmt: K.Format = K.Format()
) -> DataFrame:
    """What a witness signs at close: both heads of each run."""
    s, w = F.lit(V.WITNESS_SCHEME), F.lit(witness_id)
    return heads.select(
        "run_id", s.alias("scheme"), w.alias("witness_id"), "declaration_head", "verdict_head",
        K.hmac_sha256(
            key, K.commitment_bytes(fmt, s, w, F.col("declaration_head"), F.col("verdict_head"))
        ).alias("signature"),
    )


def verify_commitment(
    commitments: DataFrame, heads: DataFrame, witness_id: str | None, key: bytes | None,
    fmt: K.Format = K.Format(),
) -> DataFrame:
    """H7, rung by rung: unstated, none, unknown scheme and incomplete are
    could-not-evaluate; moved heads are invalid without any key; only then
    does the signature count."""
    h = heads.select(
        "run_id", F.col("declaration_head").alias("_d"), F.col("verdict_head").alias("_v")
    )
    j = commitments.join(h, "run_id", "left")
    genesis = F.lit(V.GENESIS)
    d, v = F.coalesce("_d", genesis), F.coalesce("_v", genesis)
    moved_d, moved_v = d != F.col("declaration_head"), v != F.col("verdict_head")
    incomplete = (
        ~S.is_hash(F.col("declaration_head")) | ~S.is_hash(F.col("verdict_head"))
        | F.col("witness_id").isNull() | F.col("signature").isNull()
    )
    if key is not None:
        want = K.hmac_sha256(
            key,
            K.commitment_bytes(
                fmt, F.col("scheme"), F.col("witness_id"), F.col("declaration_head"), F.col("verdict_head")
            ),
        )
        signed = want.eqNullSafe(F.col("signature"))
    else:
        signed = F.lit(False)
    rungs = [
        (F.col("scheme").isNull(), V.CNE, "states no commitment"),
        (F.col("scheme") == "none", V.CNE, "closed without a witness"),
        (F.col("scheme") != V.WITNESS_SCHEME, V.CNE, "unknown scheme"),
        (incomplete, V.CNE, "commitment is incomplete"),
        (moved_d & moved_v, V.INVALID, "declaration_head, verdict_head moved"),
        (moved_d, V.INVALID, "declaration_head moved"),
        (moved_v, V.INVALID, "verdict_head moved"),
        (F.lit(key is None), V.CNE, "heads match; no witness key offered"),
        (F.col("witness_id") != F.lit(witness_id), V.CNE, "heads match; another witness offered"),
        (~signed, V.INVALID, "signature does not verify"),
    ]
    state = reason = None
    for cond, st, why in rungs:
        state = F.when(cond, F.lit(st)) if state is None else state.when(cond, F.lit(st))
        reason = F.when(cond, F.lit(why)) if reason is None else reason.when(cond, F.lit(why))
    return j.select(
        "run_id", state.otherwise(F.lit(V.VALID)).alias("state"),
        reason.otherwise(F.lit("heads match and are signed")).alias("reason"),
    )


def select_records(records: DataFrame, rid: str, selector: str) -> DataFrame:
    """The record of each run a selector names: first, last, #n or an id."""
    pos = F.struct("seq", rid)
    if selector in ("first", "last"):
        pick = F.min(pos) if selector == "first" else F.max(pos)
        return records.groupBy("run_id").agg(pick.alias("p")).select("run_id", F.col(f"p.{rid}").alias(rid))
    if selector.startswith("#"):
        n = int(selector[1:])
        ranked = number_rows(
            records.select("run_id", "seq", rid), ["run_id"], ["seq", rid],
            F.floor(F.col("seq") / V.CHUNK_ROWS), "_pos",
        )
        if n < 0:
            size = records.groupBy("run_id").agg(F.count(F.lit(1)).alias("_n"))
            ranked = ranked.join(size, "run_id").withColumn("_pos", F.col("_pos") - F.col("_n"))
        return ranked.filter(F.col("_pos") == n).select("run_id", rid)
    return records.filter(F.col(rid) == selector).select("run_id", rid)


def tamper(
    records: DataFrame, kind: str, selector: str, set_field: str | None = None,
    value: Column | None = None, resign: bytes | None = None, fmt: K.Format = K.Format(),
) -> tuple[DataFrame, DataFrame]:
    """Delete or alter one record per run in a copy, and report before and
    after. `resign` makes the altered record's MAC verify again."""
    rid = ID[kind]
    hit = select_records(records, rid, selector).withColumn("_hit", F.lit(True))
    marked = records.join(hit, ["run_id", rid], "left")
    on = F.coalesce(F.col("_hit"), F.lit(False))
    if set_field is None:
        if resign is not None:
            raise ValueError("a deleted record cannot be signed again")
        report = marked.filter(on).select(
            "run_id", F.col(rid).alias("record_id"), "seq", F.lit("delete").alias("op"),
            F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after"),
        )
        return marked.filter(~on).select(*records.columns), report
    after = value.cast(records.schema[set_field].dataType)
    report = marked.filter(on).select(
        "run_id", F.col(rid).alias("record_id"), "seq", F.lit(f"set {set_field}").alias("op"),
        F.col(set_field).cast("string").alias("before"), after.cast("string").alias("after"),
    )
    out = marked.withColumn(set_field, F.when(on, after).otherwise(F.col(set_field)))
    if resign is not None:
        mac = K.hmac_sha256(resign, K.signing_bytes(fmt, K.head(kind), F.col("prev_hash")))
        out = out.withColumn("mac", F.when(on, mac).otherwise(F.col("mac")))
    return out.select(*records.columns), report
