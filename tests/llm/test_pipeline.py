import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pyarrow.parquet as pq
import sentencepiece
from test_jaccard_join import brute as jaccard_brute

from stoplake.llm import pii_surrogates

GAP = r"[\x20\x09-\x0D]+"


def normal(line):
    return re.sub(GAP, " ", re.sub("[0-9]+", "0", line.lower())).strip(" ")


def ends(line):
    """The first and last words of a line by which its edits are known."""
    w = line.split(" ")
    k = next((k for k, least in ((32, 64), (16, 32), (8, 16), (4, 8), (2, 4)) if len(w) >= least), 0)
    return (tuple(w[:k]), tuple(w[-k:])) if k else (None, None)


def boilerplate(rows):
    """(source, line) of the lines to remove, by the rule written out document by document."""
    hosts = defaultdict(set)
    for r in rows:
        if r["text"] is not None:
            hosts[r["source"] or ""].add(r["text"])
    bad = set()
    for host, texts in hosts.items():
        lines = {t: {x for x in map(normal, t.split("\n")) if x} for t in texts}
        n = Counter(x for own in lines.values() for x in own)
        above = {x for x in n if n[x] > 30}
        heads, tails = {ends(x)[0] for x in above} - {None}, {ends(x)[1] for x in above} - {None}
        seen = defaultdict(list)
        for t, own in lines.items():
            other = own - above
            mine = {x for x in other if ends(x)[0] not in heads and ends(x)[1] not in tails}
            spot = t if mine else "edited" if other else frozenset(own)
            for x in own & above:
                seen[x].append(min(mine) if mine else spot)
        bad |= {(host, x) for x, s in seen.items() if 100 * len(set(s)) >= 50 * len(s)}
    return bad


def quality_brute(rows):
    bad, out = boilerplate(rows), []
    for r in rows:
        text = r["text"] or ""
        words = [w for w in re.split(GAP, text) if w]
        windows = Counter(zip(words, words[1:], words[2:]))
        again = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
        if len(words) < 50 or 100 * len(again) > 50 * len(words):
            continue
        lines = text.split("\n")
        gone = [x for x in lines if (r["source"] or "", normal(x)) in bad]
        if 100 * sum(len([w for w in re.split(GAP, x) if w]) for x in gone) <= 50 * len(words):
            out.append(r | {"text": "\n".join(x for x in lines if (r["source"] or "", normal(x)) not in bad)})
    return out


def run_brute(rows, bench):
    """What is left before personal data are replaced; benchmark questions by plain search."""
    rows = quality_brute(rows)
    component = {(d, s): c for (d, s), (_, _, c) in zip([(r["doc_id"], r["text"]) for r in sorted(rows, key=lambda r: r["doc_id"])], jaccard_brute([(r["doc_id"], r["text"]) for r in sorted(rows, key=lambda r: r["doc_id"])]))}
    rows = [r for r in rows if component[r["doc_id"], r["text"]] == r["doc_id"]]
    flat = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    return [r for r in rows if not any(flat(b["text"]) in flat(r["text"]) for b in bench if (b["text"] or "").strip())]


def test_pipeline_matches_brute_force(spark, sf_dir):
    table = lambda name: pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()
    want = {r["doc_id"]: r for r in run_brute(table("documents"), table("benchmark"))}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(want)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    private = {r.doc_id for r in pii_surrogates.protect(spark.createDataFrame([(i, r["text"]) for i, r in want.items()], "doc_id long, text string")).filter("n_entities > 0").collect()}
    assert private and len(private) < len(want)
    for i, r in got.items():
        assert r.decodes and r.n_tokens == len(r.piece_ids)
        assert (list(r.piece_ids) == [*sp.encode(want[i]["text"]), sp.eos_id()]) == (i not in private)


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts, columns = [docs.count()], docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = corpus_pipeline.materialise(docs, f"test-{k}")
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert {r.doc_id for r in docs.collect()} <= {r["doc_id"] for r in pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()}


CLASHES = ["n_entities", "_pii_copy", "copy", "row", "id", "node", "new", "put", "host", "lines", "_text", "_copy", "component", "decoded", "kind", "_row"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def awkward_rows():
    fine = lambda k: " ".join(f"word{k}x{j} and" for j in range(60)) + f" mail a{k}.b@site{k}.org"
    extra = tuple("held" for _ in CLASHES)
    none = tuple(None for _ in CLASHES)
    rows = [(1, fine(1), "en", "s", 9, *extra), (1, fine(1), "en", "s", 9, *extra), (1, fine(1), "en", "s", 9, *extra), (None, fine(2), None, None, None, *none), (3, None, None, None, None, *none), (4, "", "", "", 0, *extra)]
    rows += [(5, fine(5) + " end" * 3, "en", None, 1, *extra), (6, fine(5), "en", None, 1, *extra), (7, " ".join(f"w{j}" for j in range(100_000)), "en", "s", 1, *extra), (1, fine(8), "en", "s", 2, *none)]
    return rows


def test_stages_on_awkward_rows(spark, sf_dir):
    """Nulls, empty and very long texts, ties and repeated rows, and columns that operators use themselves."""
    docs, seen = spark.createDataFrame(awkward_rows(), SCHEMA), []
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialise(stage(spark, docs, sf_dir), f"awkward-{name}")
        if name == "encoding":
            assert out.count() == docs.count() and out.filter("n_tokens < 1").count() == 0
        else:
            assert out.columns == docs.columns
            rows = out.collect()
            assert all(r[c] in ("held", None) for r in rows for c in CLASHES)
            seen.append(Counter(r.doc_id for r in rows))
    full = spark.createDataFrame(awkward_rows(), SCHEMA)
    quality, single, clean, safe = (corpus_pipeline.STAGES[k][1](spark, full, sf_dir).collect() for k in range(4))
    assert Counter(r.doc_id for r in quality) == Counter({1: 4, None: 1, 5: 1, 6: 1, 7: 1})
    assert Counter(r.doc_id for r in single) == Counter({1: 2, None: 1, 3: 1, 4: 1, 5: 1, 7: 1})
    assert len(clean) == len(safe) == 10
    assert {r.doc_id: r.n_chars for r in safe}[3] is None and not any(re.search(r"a\d\.b@site", r.text or "") for r in safe)
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == []
