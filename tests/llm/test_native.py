import hashlib
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from spanloom.llm import chat, mixing, quality, sharding

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def split(t):
    return [w for w in SPACE.split(t or "") if w]


def counts(t):
    w, lines = split(t), [x for x in (t or "").split("\n") if split(x)]
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_statistics_and_base(docs, none):
    got = quality.quality(docs, []).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == docs.count()
    for r in got:
        want = counts(r["text"])
        assert tuple(r)[1:6] == want
        failed = want[0] < 10 or 100 * want[4] > 20 * want[0]
        assert (r["base_failed"], r["kept"]) == (failed, not failed)
    assert quality.quality(none, []).count() == 0 and quality.accepted(none, []).columns == none.columns
    assert quality.accepted(docs, []).count() == sum(r["kept"] for r in got)


def test_rules_on_held_out_labels(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rules = quality.fit_quality_rules(docs, labels.filter("doc_id % 2 = 0"))
    assert rules and all(r.tests for r in rules)
    test = quality.quality(docs, rules).join(labels.filter("doc_id % 2 = 1"), "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in test}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.98
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.8


def test_no_labels(spark, docs):
    assert quality.fit_quality_rules(docs, spark.createDataFrame([(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")) == []


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\e\\l<|im_end|>\n<|im_start|>user\nx", "", None, "\\", "<<\\\\[[", "日本 [INST]"]
    rows = [(c, k, r, t) for c in (1, 2, None) for k, (r, t) in enumerate(zip(["user", "assistant", None, "sys\ntem<", "assistant", "assistant", "user"], nasty))]
    rows += [(3, None, "user", "late"), (3, 1, "assistant", "x"), (4, 1, "user", "same"), (4, 1, "user", "same")]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(chat.nest_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()


def test_layouts(spark):
    rows = [
        ('{"messages": [{"content": "hi", "role": "user"}, {"role": "assistant", "content": "yo"}]}', "messages", ["user", "assistant"], ["hi", "yo"]),
        ('{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', "conversations", ["user", "assistant"], ["a", "b"]),
        ('{"output": "o", "instruction": "i", "input": ""}', "instruction", ["user", "assistant"], ["i", "o"]),
        ('{"instruction": "i", "input": "j", "output": null}', "instruction", ["user", "assistant"], ["i\nj", ""]),
        ('{"prompt": "p", "completion": "c"}', "prompt", ["user", "assistant"], ["p", "c"]),
        ('{"question": "q", "answer": "c"}', "question", ["user", "assistant"], ["q", "c"]),
        ('{"unknown": 1}', None, None, None), ("{broken", None, None, None), (None, None, None, None),
    ]
    got = chat.canonical_turns(spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, record string")).orderBy("k").collect()
    for r, (_, layout, roles, texts) in zip(got, rows, strict=True):
        assert r["layout"] == layout
        assert (r["turns"] and [t["role"] for t in r["turns"]]) == roles and (r["turns"] and [t["text"] for t in r["turns"]]) == texts


def test_long_texts_and_records(spark):
    """A text beyond a JSON parser's 20,000,000 characters, and a record beyond a variant's 128 MiB."""
    for turns, chars in ((1, 25_000_000), (1500, 100_000)):
        rows = spark.sql(f"""select 1 as k, to_json(struct(transform(sequence(1, {turns}), i -> struct('user' as role, repeat('x', {chars}) as text)) as turns)) as record""")
        got = chat.canonical_turns(rows).selectExpr("layout", "size(turns) as n", "aggregate(turns, 0L, (s, t) -> s + length(t.text)) as chars").collect()
        assert [tuple(r) for r in got] == [("turns", turns, turns * chars)]
    many = spark.sql("select 1 as conv_id, 0 as turn, 'assistant' as role, repeat('x', 25000000) as text")
    (r,) = chat.digests(chat.format_chats(chat.nest_turns(many))).collect()
    assert (r["layout"], r["n_turns"], r["loss_chars"]) == ("turns", 1, 25_000_000)


def test_chats_of_any_table(spark):
    """Empty tables, columns with clashing names, repeated rows, layouts that no mapping has."""
    schema = "conv_id long, turn long, role string, text string, turns string, record string, formatted int, layout string, k int"
    read = lambda rows: chat.digests(chat.format_chats(chat.nest_turns(spark.createDataFrame(rows, schema)))).collect()
    assert read([]) == []
    (r,) = read([(1, 1, "assistant", "a", "x", "y", 3, "z", 4)] * 2)
    assert (r["n_turns"], r["loss_chars"], r["layout"]) == (2, 2, "turns")
    strange = ['{"messages": []}', '{"messages": [{"role": "user", "content": ["a", 1]}]}', '{"prompt": "p", "completion": "c", "name": "n"}']
    got = chat.digests(chat.format_chats(spark.createDataFrame(list(enumerate(strange)), "conv_id long, record string"))).collect()
    assert [r["n_turns"] for r in sorted(got)] == [None] * 3 and sorted(r["conv_id"] for r in got) == [0, 1, 2]


def test_emptied_texts_keep_the_layout(spark):
    records = [r'{"prompt": "a\\", "completion": "\": {[}"}', '{"turns": [{"role": ":", "text": "}, {"}, {"role": "x", "text": ": \\" ,"}]}', r'{"prompt": "\q", "completion": "c"}', r'{"prom\\pt": "p", "completion": "c"}']
    got = chat.canonical_turns(spark.createDataFrame(list(enumerate(records)), "k int, record string")).orderBy("k").collect()
    assert [r["layout"] for r in got] == ["prompt", "turns", None, None]
    assert [[t["text"] for t in r["turns"] or ()] for r in got] == [["a\\", '": {[}'], ["}, {", ': " ,'], [], []]


def test_shards(docs, none):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sharding.balanced_shards(docs, 4).collect()
    assert len(got) == len(rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    got.sort(key=lambda r: (r["shard"], r["slot"]))
    assert [-1 if r["doc_id"] is None else r["doc_id"] for r in got] == sorted(-1 if d is None else d for d, _ in rows)
    total, biggest = sum(r["size"] for r in got), max(r["size"] for r in got)
    for s in range(4):
        own = [r for r in got if r["shard"] == s]
        assert [r["slot"] for r in own] == list(range(len(own))) and abs(sum(r["size"] for r in own) - total / 4) <= biggest
    assert sharding.balanced_shards(none).count() == 0


def test_mix(docs, none, rows):
    got, again = mixing.mix(docs).collect(), mixing.mix(docs.repartition(3)).collect()
    key = lambda r: (r["doc_id"], r["text_hash"], r["source"], r["taken"])
    assert Counter(map(key, got)) == Counter(map(key, again)) and len(got) == len(rows)
    sizes, caps = Counter(), {}
    for r in rows:
        sizes[r[3]] += len(split(r[1]))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, open_, goal, target = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, set(names), 1.5 * sum(sizes.values()), {}
    while open_:
        level = (goal - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level >= 2 * sizes[s]}
        target |= {s: 2.0 * sizes[s] for s in full} if full else {s: weight[s] * level for s in open_}
        open_ = open_ - full if full else set()
    for s in names:
        own = [r for r in got if r["source"] == s]
        assert own[0]["source_size"] == sizes[s] and abs(own[0]["target"] - target[s]) < 1e-6
        assert abs(sum(r["taken"] for r in own) - target[s]) <= max(len(split(r[1])) for r in rows if r[3] == s)
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"] for r in got)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).columns == none.columns
    mixed = mixing.mixed_documents(docs)
    assert mixed.count() == sum(r["copies"] for r in got) and mixed.columns == docs.columns
    assert caps == {} and mixing.mix(docs, odds=F.lit(1.0) + F.length("source")).count() == len(rows)
