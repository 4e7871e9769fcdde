"""The training-data operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import itertools
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexloom.llm import bpe, chat, exact_dedup, graph, html, lines, lm, minhash, packing, queries, topk, toxicity

DIR = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "a  b", " lead", "x ", "tab\t y z", "<|endoftext|>", "hi<|endoftext|> there", "aaaaaaaa" * 40, "it's we'll I'm'd",
    "a\r\n\r\n  b", "日本語 😀😀 Āā", "1 23 ½ ²", "x" * 3000, "\x1c a \x85c", "word " * 20_000,
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.TOKENIZER)


def odd_docs(spark):
    rows = [(k, x, "clash") for k, x in enumerate(ODD)] + [(None, "null id", "x"), (3, "a  b", "y"), (3, "a  b", "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string")


def documents(spark):
    return spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# --- 1


def test_bpe_equals_the_library(spark, tokenizer):
    got = bpe.bpe_round_trip(odd_docs(spark), queries.TOKENIZER).collect()
    for r in got:
        assert r.ids == tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == tokenizer.decode(r.ids, skip_special_tokens=False)
    assert bpe.bpe_round_trip(empty(spark), queries.TOKENIZER).count() == 0


def test_bpe_random_texts(tokenizer):
    rng = random.Random(1)
    texts = ["".join(rng.choice(" \n\tab'sé \xa0<|>endof1²́😀\x85") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    v = bpe.Vocabulary(bpe.tokenizer_text(queries.TOKENIZER))
    ids, counts = bpe.Encoder(v).encode(texts)
    for text, mine in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert mine.tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_pair_check_is_what_merging_does():
    v = bpe.Vocabulary(bpe.tokenizer_text(queries.TOKENIZER))
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 50_000, 3000), rng.integers(0, 50_000, 3000)
    stable = v.stable(a, b)
    for x, y, good in zip(a.tolist(), b.tolist(), stable.tolist(), strict=True):
        ids, _ = v.merge([v.bytes[x] + v.bytes[y]])
        assert good == (ids.tolist() == [x, y])
        assert v.merge_long(v.bytes[x] + v.bytes[y]) == ids.tolist()


def test_bpe_decodes_any_ids(spark, tokenizer):
    rng = random.Random(2)
    rows = [(k, [rng.randrange(50_257) for _ in range(rng.randint(0, 30))]) for k in range(200)] + [(200, None)]
    got = bpe.bpe_decode(spark.createDataFrame(rows, "k int, ids array<int>"), queries.TOKENIZER).collect()
    assert all(r.decoded == tokenizer.decode(r.ids or [], skip_special_tokens=False) for r in got)


# --- 2


def test_escapes_are_reversible():
    rng = random.Random(3)
    parts = [*chat.CONTROL, *chat.ESCAPES.values(), "&", "<", "[", "amp;", "lt;", "x", "\n", "|im_end|>"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 8)))
        coded = chat.escape(text)
        assert chat.unescape(coded) == text and not any(c in coded for c in chat.CONTROL)


def folded(log):
    """The log folded one event after another."""
    out: dict = {}
    for seq, kind, message, role, text in sorted(log, key=lambda e: (e[0], {"message": 0, "delta": 2}.get(e[1], 1))):
        if kind == "message":
            out[message] = [seq, role, text]
        elif message in out:
            if kind == "delta":
                out[message][2] += text
            elif kind == "edit":
                out[message][2] = text
            else:
                for m in [m for m, x in out.items() if out[message][0] < x[0] < seq]:
                    del out[m]
                out[message][2] = ""
    return [(r, t) for s, r, t in sorted(out.values())]


def test_fold_equals_replay(spark):
    rng = random.Random(4)
    logs, rows = {}, []
    for conv in range(12):
        log, opened = [], []
        for seq in range(rng.randint(1, 900 if conv < 2 else 40)):
            kind = rng.choices(["message", "delta", "edit", "regenerate"], [3, 6, 1, 0.3])[0]
            if kind == "message" or not opened:
                opened.append(seq)
                log.append((seq, "message", seq, rng.choice(["user", "assistant"]), f"m{seq}"))
            else:
                log.append((seq, kind, rng.choice(opened[-3:]), None, f"<{seq}>"))
        logs[conv] = log
        rows += [(conv, *e) for e in log]
    # an event on a message that a regeneration dropped is replayed on nothing; both sides ignore it
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "conv_id int, seq long, kind string, message long, role string, text string")
    got = {r.conv_id: chat.read_back(r.formatted) for r in chat.format_chats(events).collect()}
    assert got == {c: folded(log) for c, log in logs.items()}


def test_chat_odd_rows(spark):
    rows = [(None, 0, "user", "a"), (None, 0, None, None), (5, None, "tool\n<|im_end|>", "x"), (5, 2, "assistant", ""), (5, 2, "assistant", "")]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.format_chats(chat.as_events(turns)).collect()}
    assert chat.read_back(got[5].formatted) == [("tool\n<|im_end|>", "x"), ("assistant", ""), ("assistant", "")] and len(got[5].loss_spans) == 2
    assert chat.read_back(got[None].formatted) == [("", ""), ("user", "a")]
    assert chat.digests(chat.format_chats(chat.as_events(turns.limit(0)))).count() == 0


# --- 3


def test_lm_base_and_gain(spark):
    docs = documents(spark)
    held = toxicity.bucket(F.col("doc_id")) % 10 == 0
    got = {r.doc_id: r for r in lm.score(docs, ~held).collect()}
    rows = docs.collect()
    tokens = {r.doc_id: r.text.encode().lower().split() + [b"\n"] for r in rows}
    out = {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 10 == 0}
    counts = Counter(itertools.chain.from_iterable(t for k, t in tokens.items() if k not in out))
    n, v = sum(counts.values()), len(counts)
    for k, t in tokens.items():
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.trained) == (len(t), sum(w in counts for w in t), n, k not in out)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
    per_token = lambda c: sum(getattr(got[k], c) for k in out) / sum(got[k].n_tokens for k in out)
    assert per_token("score") > per_token("base_score") + 0.2
    # the registered query: the same split, learnt without the rows held out
    for r in queries.op3_lm(spark, DIR).collect():
        assert r.held_out == (r.doc_id in out) and (r.n_tokens, r.train_tokens) == (len(tokens[r.doc_id]), n)
        assert r.score == pytest.approx(got[r.doc_id].score, abs=1e-6)


def lm_model(docs, train_on, **more):
    """The model as the query ships it, its pairs' probabilities by (context, word), and the decoded seating of each sample."""
    options = {"sweeps": 2, "samples": 2, "rounds": 3, "bucket_bytes": 200, "seed": 5} | more
    model = lm.Model(docs, train_on, "doc_id", "text", *options.values())
    asked: dict = {}
    for r in model.of(model.blocks, lm.ASKED).collect():
        asked.setdefault(r.bucket, []).append(r.asDict())
    pairs = {b: lm.Pairs(m) for b, m in asked.items()}
    shipped = {}
    for r in model.answers().collect():
        p = pairs[r.bucket]
        at = p.back[p.blocks.index(r.a)]
        for k, x in zip(at.tolist(), lm.unpack(r.data[0]).tolist(), strict=True):
            shipped[int(p.contexts[p.at[k]]), list(p.words)[p.word[k]]] = 10 ** (-x / lm.FINE)
    seats = {(r.a, r.bucket): lm.Bucket.read(r.data[:-1]) for r in model.states().collect()}
    return model, pairs, shipped, seats


def test_lm_shipped_probabilities_add_up_and_equal_the_formula(spark):
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(12)]
    rows = [(k, " ".join(rng.choices(vocabulary, [12 - j for j in range(12)], k=rng.randint(0, 60)))) for k in range(40)]
    asking = [(1000 + k, " ".join(x for w in [*vocabulary, "never"] for x in (u, w)) + f" {u}") for k, u in enumerate(["w0", "w5", "never"])]
    docs = spark.createDataFrame(rows + asking, "doc_id long, text string").repartition(3)
    model, pairs, shipped, seats = lm_model(docs, F.col("doc_id") < 1000)
    words = {lm.context_of(w.encode()): w for w in [*vocabulary, "never"]}
    for u in ("w0", "w5", "never"):
        assert sum(shipped[lm.context_of(u.encode()), w] for w in [*(x.encode() for x in vocabulary), b"never", lm.END]) == pytest.approx(1, abs=1e-6)
    # the formula over dictionaries of customers and tables
    counts = Counter()
    for _, text in rows:
        before = "BEGIN"
        for w in [*text.split(), lm.END.decode()]:
            counts[before, w] += 1
            before = w
    mean = Counter()
    for sweep, s in model.sums.items():
        tables, root = {}, {}
        for b, p in pairs.items():
            x = seats[sweep, b]
            names = [w.decode() for w in p.words]
            seated = iter(x.leaf.tables.tolist())
            for w, at, c in zip(p.word.tolist(), p.at.tolist(), p.count.tolist(), strict=True):
                context = words.get(int(p.contexts[at]), "BEGIN")
                assert counts[context, names[w]] == c
                tables[context, names[w]] = c if c < 2 else next(seated)
            assert (x.leaf.customers == x.count).all() and (x.leaf.n > 0).all() and (x.root.customers == x.customers_due()).all() and (x.root.n > 0).all()
            root |= {names[k]: v for k, v in enumerate(zip(x.root.customers.tolist(), x.root.tables.tolist(), strict=True))}
        assert s.vocabulary == 13 and s.tokens == sum(counts.values())
        assert s.customers == sum(c for c, _ in root.values()) == sum(tables.values()) and s.tables == sum(t for _, t in root.values())
        for u, w in shipped:
            u, w = words.get(u, "BEGIN"), w.decode()
            c, t = root[w]
            above = (c - s.root_discount * t + (1 + s.root_discount * s.tables) / 14) / (1 + s.customers)
            here = sum(n for (a, _), n in counts.items() if a == u), sum(n for (a, _), n in tables.items() if a == u)
            mean[u, w] += (counts[u, w] - s.discount * tables[u, w] + (1 + s.discount * here[1]) * above) / (1 + here[0]) / len(model.sums)
    for (u, w), x in shipped.items():
        assert x == pytest.approx(mean[words.get(u, "BEGIN"), w.decode()], rel=1e-6)


def test_lm_moves_leave_the_exact_distribution_of_tables():
    """One dish of c customers, all else fixed: the chance of t tables is known in closed form."""
    d, others, above, c, n = 0.6, 3, 0.4, 7, 4000
    ways = np.zeros((c + 1, c + 1))  # generalised Stirling numbers
    ways[0, 0] = 1
    for a in range(c):
        for t in range(a + 2):
            ways[a + 1, t] = (ways[a, t - 1] if t else 0) + max(a - d * t, 0) * ways[a, t]
    want = np.array([ways[c, t] * np.prod([(lm.STRENGTH + d * (others + k)) * above for k in range(t)]) for t in range(c + 1)])
    want[0] = 0
    rng = np.random.default_rng(1)
    dishes = lm.Seating(np.ones(n, np.int64), np.full(n, c))
    for _ in range(60):
        now = dishes.tables
        change = dishes.move(lambda who, gone, now=now: (lm.STRENGTH + d * (others + now[who] - gone)) * above, d, rng)
        assert (dishes.tables == now + change).all() and (dishes.customers == c).all() and (dishes.n > 0).all()
    got = np.bincount(dishes.tables, minlength=c + 1) / n
    assert np.abs(got - want / want.sum()).max() < 0.03


def test_lm_arrivals_and_leaves():
    rng = np.random.default_rng(2)
    seats = lm.Seating(np.array([0, 1, 2]), np.array([3, 1, 1]))
    opened = seats.arrive(np.array([5, 0, 100_000]), lambda who, k: np.full(len(who), 2.0), 0.5, rng)
    assert seats.customers.tolist() == [5, 3, 100_002] and seats.tables.tolist() == [opened[0], 1, 2 + opened[2]] and opened[2] > 3
    seats.leave(np.array([4, 0, 90_000]), rng)
    assert seats.customers.tolist() == [1, 3, 10_002] and (seats.n > 0).all()


def test_lm_odd_rows(spark):
    got = lm.score(odd_docs(spark).withColumn("score", F.lit("clash")).withColumn("trained", F.lit(3)), F.col("doc_id").isNotNull()).collect()
    assert len(got) == len(ODD) + 3 and all(np.isfinite(r.score) for r in got)
    assert [r.n_tokens for r in got if r.doc_id == 0] == [1]
    assert lm.score(empty(spark), F.lit(True)).count() == 0
    assert lm.score(documents(spark).limit(5), F.lit(False)).filter("n_known > 0").count() == 0


# --- 4


def test_packing(spark, tokenizer):
    docs = documents(spark).union(odd_docs(spark).select("doc_id", "text").filter("doc_id != 3").withColumn("doc_id", F.col("doc_id") + 10_000))
    got = packing.pack(docs, queries.TOKENIZER, block_items=100).toPandas()
    total = 0
    for doc_id, text in docs.collect():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = got[got.doc_id == doc_id].sort_values("piece")
        assert mine.length.sum() == len(ids) and mine.start.tolist() == [0, *np.cumsum(mine.length)[:-1]] and (mine.length[1:] == 2048).all()
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist()
        total += len(ids)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-total // 2048) + 4
    assert packing.pack(empty(spark), queries.TOKENIZER).count() == 0


def test_crossover_keeps_every_item_once():
    rng = np.random.default_rng(5)
    lengths = rng.integers(1, 1500, 400)
    a, b = packing.first_packings(lengths, 2048, 2, rng)
    for _ in range(50):
        child = packing.crossover(a, b, lengths, 2048, rng)
        assert len(child.assigned) == 400 and child.fill.max() <= 2048 and child.fill.sum() == lengths.sum() and (child.fill > 0).all()


def test_crossovers_save_sequences_on_a_hard_instance():
    """Triplets that fill a bin exactly: best fit needs a sixth more bins than there are triplets."""
    for seed in range(3):
        rng = np.random.default_rng(seed)
        a = rng.integers(380, 490, 120)
        b = rng.integers(250, (1000 - a) // 2 + 1)
        lengths = rng.permutation(np.concatenate([a, b, 1000 - a - b]))
        first = packing.first_packings(lengths, 1000, 4, rng)
        least = min(len(x.fill) for x in first)
        best = packing.evolve(list(first), lengths, 1000, 60, rng)[0]
        assert least >= 138 and len(best.fill) <= 123, (least, len(best.fill))
        assert best.fill.max() <= 1000 and (np.bincount(best.assigned, lengths) == best.fill).all()
        # an elite that comes to another island leads there, and no generation loses it
        guest = packing.evolve([*packing.first_packings(lengths, 1000, 4, rng), best], lengths, 1000, 3, rng)
        assert len(guest[0].fill) <= len(best.fill)


def test_exchange_fills_bins_better():
    lengths = [6, 4, 3, 7, 5, 2]
    assigned = np.array([0, 0, 0, -1, -1, -1])
    fill = [13]
    left = packing.exchange({0: [0, 1, 2]}, fill, [3, 4, 5], lengths, assigned, 15)
    assert fill == [15] and sum(lengths[i] for i in left) == 12 and len({*left, *np.flatnonzero(assigned == 0).tolist()}) == 6


# --- 5


def test_bag_minhash_estimates_the_weighted_similarity():
    rng = random.Random(6)
    base = [f"w{rng.randrange(80)}" for _ in range(300)] + ["r1 r2 r3 r4 r5 r6"] * 1
    base += base[:60] * 4
    other = base[:-90]
    text, key, weight = minhash.weighted_shingles([base, other])
    assert weight.max() > 3
    signature = minhash.bag_minhash(text, key, weight, 2, 8000)
    exact = minhash.similarity((key[text == 0], weight[text == 0]), (key[text == 1], weight[text == 1]))
    a, b = (Counter(tuple(x[k : k + 5]) for k in range(len(x) - 4)) for x in (base, other))
    assert exact == pytest.approx(sum((a & b).values()) / sum((a | b).values()))
    assert (signature[0] == signature[1]).mean() == pytest.approx(exact, abs=0.03)


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(7)
    docs = [(r.doc_id, r.text) for r in documents(spark).collect()]
    family = [f"f{rng.randrange(500)}" for _ in range(150)]
    for k in range(120):  # copies with more and less change, around the threshold
        mine = list(family)
        for _ in range(rng.randint(0, 6)):
            mine[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        docs.append((5000 + k, " ".join(mine)))
    docs += [(9000, None), (9001, ""), (9002, "two words"), (9003, "Two  words"), (None, "two words")]
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, class_id string")
    bags = [Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := minhash.words(t)) else Counter() for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if bags[a] and bags[b] and (shared := sum((bags[a] & bags[b]).values())) and shared / (bags[a].total() + bags[b].total() - shared) >= 0.8:
            parent[find(b)] = find(a)
    classes: dict = {}
    for k, (i, _) in enumerate(docs):
        classes.setdefault(find(k), []).append(float("inf") if i is None else i)
    want = sorted(min(c) for c in classes.values() for _ in c)
    got = minhash.near_duplicates(frame).collect()
    assert sorted(r.class_id for r in got) == want
    assert sum(r.kept for r in got) == len(classes)
    kept = minhash.drop_near_copies(frame)
    assert kept.columns == frame.columns and kept.count() == len(classes)
    assert minhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)}


# --- 6


def test_html():
    page = """<html><body class="no-sidebar"><header>Site</header><nav>Menu <a>One</a></nav><div id="cookie-banner">We use cookies</div>
    <div class="wrap"><div class="content"><h1>Title  here</h1><p>First paragraph that is long enough to be seen as content.<p>Second &eacute; para&nbsp;graph &amp;lt;
    with <a href=x>a link</a> and more text.<ul><li>One<li>Two</ul><aside>Side</aside><form>Sign up</form><script>var x="</p>";</script><p>St.</p></div>
    <div class="sidebar"><p>Long long long long long long long long text at the side</p></div></div>
    <section id="comments"><p>A reader's comment that is long and goes on for quite a while, longer than the rest of it all.</p></section><footer>(c)</footer><!-- open"""
    want = ["Title here", "First paragraph that is long enough to be seen as content.", "Second é para graph &lt; with a link and more text.", "One", "Two", "St."]
    assert html.main_text(page).split("\n\n") == want
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x</script>") == ""
    assert html.main_text("just text") == "just text"
    assert len(html.main_text("<p>" + "word " * 200_000)) == 999_999


def test_html_without_article_keeps_all_content():
    def prose(name, n):
        return [f"{name} {k} is a sentence of the main text that goes on for a while." for k in range(n)]

    def paragraphs(texts):
        return "".join(f"<p>{x}</p>" for x in texts)

    lead, story = prose("lead", 3), prose("story", 17)
    links = "<div>" + "".join(f"<a href=/{k}>Link {k}</a> " for k in range(20)) + "</div>"
    page = f"<body>{links}<div class=wrap><h1>Title</h1><div class=lead>{paragraphs(lead)}</div><p>Short.</p><div class=story>{paragraphs(story)}</div></div><footer>(c)</footer></body>"
    assert html.main_text(page).split("\n\n") == ["Title", *lead, "Short.", *story]
    apart = f"<body>{links}<div><h1>Title</h1></div>{links}<div>{paragraphs(story)}</div><div><div>{paragraphs(lead)}</div></div>{links}</body>"
    assert html.main_text(apart).split("\n\n") == ["Title", *story, *lead]


def test_html_words_in_ids_of_the_article():
    def text(name):
        return f"{name} is a sentence of the article that goes on for quite a while, like all the others."

    links = " ".join(f"<a href=/{k}>Related piece {k}</a>" for k in range(9))
    page = f"""<body><nav>Menu</nav><article><h1>Title</h1><p>{text("A")}</p><section id="social-history"><h2 id="related-work">Related work</h2><p>{text("B")}</p>
    <p class="notice" id="comment-1">{text("C")}</p></section><div id="advertising-in-sport"><p>{text("D")} <span class="skip">{text("E")}</span></p></div>
    <div id="related-pieces">{links}</div><div id="share-this">Share</div><div id="newsletter-box"><p>{text("F")}</p><form><button>Sign up</button></form></div>
    <div id="sponsored"><p>{text("G")}</p></div><div class="promo box"><p>{text("H")}</p></div><div id="comments-list"><p>{text("I")}</p></div></article>
    <div id="cookie-note"><p>{text("J")}</p></div></body>"""
    assert html.main_text(page).split("\n\n") == ["Title", text("A"), "Related work", text("B"), text("C"), f"{text('D')} {text('E')}"]


def test_html_comment_marks_that_open_no_comment():
    for before in ('<script>var s="<!--";</script>', "<script><!-- code </script>", "<style><!-- p {} </style>", '<a title="<!--">Link</a>', "<textarea><!-- x</textarea>", "<title>a <!-- b</title>", "<svg><title/></svg>", "<!-- done -->"):
        assert html.main_text(f"<body>{before}<article><p>All of the text.</p></article></body>") == "All of the text.", before
    assert html.main_text("<article><p>Text.</p><!-- open <p>hidden</p></article>") == "Text."
    assert html.main_text('<article><p>Text.</p><script>"<!--"</script><p>More.</p><!-- open <p>hidden</p>') == "Text.\n\nMore."


def test_html_layouts_that_hold_the_text():
    def text(name):
        return f"{name} is a sentence of the article that goes on for quite a while, like all the others of it."

    def prose(names):
        return "".join(f"<p>{text(x)}</p>" for x in names)

    nav = "<nav><a href=/>Home</a> <a href=/x>News</a></nav><footer>(c) 2024</footer>"
    # one form around the whole body
    assert html.main_text(f"<body><form action=/>{nav}<div><h1>Title</h1>{prose('ABCD')}</div><input type=hidden></form></body>") == "\n\n".join(["Title", *map(text, "ABCD")])
    assert html.main_text(f"<body><form action=/>{nav}<div>{prose('ABCDEFG')}</div></form></body>") == "\n\n".join(map(text, "ABCDEFG"))
    assert html.main_text(f"<body><article><h1>Title</h1>{prose('AB')}</article><form><p>{text('Z')}</p><button>Send</button></form></body>") == "\n\n".join(["Title", *map(text, "AB")])
    # words of a longer class on a part of the article
    page = f"""<body>{nav}<article><h1>Title</h1><p class="share-of-gdp">{text("A")}</p><div class="related-work"><p>{text("B")}</p></div>
    <div class="related-links"><a href=/1>One more piece</a> <a href=/2>Another piece</a></div><div class="ad-slot"><p>{text("Z")}</p></div></article></body>"""
    assert html.main_text(page) == "\n\n".join(["Title", text("A"), text("B")])
    # formulas, scripts and controls inside a paragraph
    page = f"<body><article><p>{text('A')} <math><mi>x</mi><mo>=</mo><mn>2</mn></math> as we saw<script>var a = 1;</script>, and <svg><title>icon</title></svg>then <button>Copy</button>more.</p></article></body>"
    assert html.main_text(page) == f"{text('A')} x=2 as we saw, and then more."
    # two articles, and teasers beside them
    teaser = "<article><h3><a href=/t>A teaser</a></h3><p>Short words.</p></article>"
    page = f"<body>{nav}<main><article><h1>One</h1>{prose('ABCDEFGHIJKLMN')}</article><article><h2>Two</h2>{prose('OP')}</article>{teaser}</main></body>"
    assert html.main_text(page) == "\n\n".join(["One", *map(text, "ABCDEFGHIJKLMN"), "Two", *map(text, "OP")])
    # the header of an entry, and that of the site
    page = f"<body><header>The Site</header><div class='article'><header><h1>Title</h1></header>{prose('ABC')}</div><footer>(c)</footer></body>"
    assert html.main_text(page) == "\n\n".join(["Title", *map(text, "ABC")])


def test_html_odd_rows(spark):
    page = "<article><p>Text of the page.</p></article>"
    rows = [(1, "u", page, "x", 1), (1, "u", page, "y", 2), (None, None, page, "z", 3), (2, "v", "", None, None), (3, "v", None, None, None)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    assert sorted((r.page_id or 0, r.url or "", r.text, r.n_chars) for r in got) == [(0, "", "Text of the page.", 17), (1, "u", "Text of the page.", 17), (1, "u", "Text of the page.", 17), (2, "v", "", 0), (3, "v", "", 0)]


def test_html_pages(spark):
    import html as h
    import re

    pages = spark.read.parquet(f"{DIR}/pages.parquet")
    got = {r.page_id: r for r in html.extract(pages.union(spark.createDataFrame([(-1, None, None)], pages.schema))).collect()}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = (" ".join(h.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split("</?(?:p|h1)>", inner.replace("<b>", "").replace("</b>", "")))
        assert got[r.page_id].text == "\n\n".join(filter(None, blocks)) and got[r.page_id].n_chars == len(got[r.page_id].text)
    assert (got[-1].text, got[-1].n_chars, got[-1].url) == ("", 0, None)
    assert html.extract(pages.limit(0)).count() == 0


# --- 7


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(8)
    plain = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    rows = []
    for k in range(1500):
        words = [rng.choice(plain) for _ in range(rng.randint(20, 120))]
        if toxic := k % 4 == 0:
            for _ in range(4):
                words[rng.randrange(len(words))] = "vrask" + rng.choice(plain)  # a stem with endings never seen alike
        rows.append((k, " ".join(words), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = toxicity.bucket(F.col("id")) % 5 == 0
    model = toxicity.train(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"), ~held)
    got = toxicity.score(frame, model).filter(toxicity.bucket(F.col("doc_id")) % 5 == 0).collect()
    assert sum((r.toxicity >= 0.5) == bool(r.toxic) for r in got) > 0.97 * len(got)


def direct_kneser_ney(counts: list[Counter], order: int, shared: int, letters: int):
    """log p(word | class 1) - log p(word | class 0), straight from the definition."""
    framed = lambda w: "\x02" + w + "\x03"

    def level(words: Counter, size: int, top: bool):
        grams: Counter = Counter()
        longer = set()
        for word, n in words.items():
            x = framed(word)
            for at in range(max(size, 1), len(x)):
                if top or (at == size and size):
                    grams[x[at - size : at], x[at]] += n
                elif at > size and (gram := x[at - size - 1 : at + 1]) not in longer:
                    longer.add(gram)
                    grams[x[at - size : at], x[at]] += 1
        ones, twos = (sum(1 for c in grams.values() if c == k) for k in (1, 2))
        d = min(0.95, max(0.1, ones / (ones + 2 * twos) if ones else 0.5))
        totals: Counter = Counter()
        spared: Counter = Counter()
        for (context, _), c in grams.items():
            totals[context] += c
            spared[context] += c - max(c - d, 0)
        return lambda context, x, p: max(grams[context, x] - d, 0) / totals[context] + spared[context] / totals[context] * p if totals[context] else p

    both = counts[0] + counts[1]
    models = [[level(both if k <= shared else c, k, k == order - 1) for k in range(order)] for c in counts]

    def log_p(model, word):
        x, total = framed(word), 0.0
        for at in range(1, len(x)):
            p = 1.0 / (letters + 1)
            for size in range(min(at, order - 1) + 1):
                p = model[size](x[at - size : at], x[at], p)
            total += np.log(p)
        return total

    return lambda word: log_p(models[1], word) - log_p(models[0], word)


def test_spelling_equals_the_definition():
    rng = random.Random(21)
    make = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(1, 7)))
    counts = [Counter(make("abcde") for _ in range(120)), Counter(make("abcxy") for _ in range(60))]
    spelling = toxicity.Spelling(counts, order=4, shared=1)
    want = direct_kneser_ney(counts, 4, 1, spelling.letters)
    words = [*list(counts[0])[:20], *list(counts[1])[:20], "unseen", "zzz", "a", "abcabcabc"]
    assert np.allclose(spelling.log_odds(words), [want(w) for w in words], atol=1e-9)


def test_toxicity_curve_weights_stand_for_rows():
    rng = np.random.default_rng(3)
    x, y, n = toxicity.features(rng.normal(size=60), rng.integers(1, 9, 60)), rng.integers(0, 2, 60), rng.integers(1, 5, 60)
    assert np.allclose(toxicity.fit_curve(x, y, n.astype(float)), toxicity.fit_curve(np.repeat(x, n, 0), np.repeat(y, n)), atol=1e-6)


def test_toxicity_prior_does_not_depend_on_the_bound(spark):
    rng = np.random.default_rng(2)
    rows = []
    for k in range(4000):  # one toxic row in ten, with words that only lean one way, and texts without words
        toxic = k % 10 == 0
        words = rng.choice(["alpha", "bravo", "gamma", "delta"], 4, p=[0.4, 0.3, 0.2, 0.1] if toxic else [0.1, 0.2, 0.3, 0.4])
        rows.append((k, "" if k % 7 == 0 else " ".join(words), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    texts = [""] + [x[1] for x in rows]
    whole, bounded = (toxicity.train(frame, frame, rows_for_each_label=n).scores(texts) for n in (4000, 60))
    assert bounded[0] < 0.3, bounded[0]  # a text without words: 0.5 where the bound alone sets the proportion
    assert abs(whole.mean() - 0.1) < 0.05 > abs(bounded.mean() - 0.1), (whole.mean(), bounded.mean())


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(0, 1), (1, 0), (None, 1), (2, None), (0, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs(spark), labels)
    got = toxicity.score(odd_docs(spark).withColumn("toxicity", F.lit("clash")), model).collect()
    assert len(got) == len(ODD) + 3 and all(0 <= r.toxicity <= 1 for r in got)
    assert toxicity.score(empty(spark), model).count() == 0
    none = toxicity.train(documents(spark), labels.limit(0))
    assert {r.toxicity < 1e-9 for r in toxicity.score(documents(spark), none).collect()} == {True}


# --- 8


def test_exact_dedup_odd_rows(spark):
    long = "long " * 300_000
    rows = [(5, "a b"), (3, "a \t b"), (3, "a\nb"), (9, None), (8, ""), (7, " "), (None, "a b"), (None, "z"), (4, "a\xa0b"), (11, long), (10, long + " ")]
    for parts in (1, 5, 11):
        frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int").repartition(parts)
        got = exact_dedup.exact_dedup(frame).collect()
        assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.kept) for r in got if r.keep_id == 3) == [(-1, 3, 4, False), (3, 3, 4, False), (3, 3, 4, True), (5, 3, 4, False)]
        assert {(r.keep_id, r.group_size) for r in got if r.doc_id in (8, 9)} == {(8, 2)}
        assert {(r.keep_id, r.group_size, r.kept) for r in got if r.doc_id in (10, 11)} == {(10, 2, True), (10, 2, False)}
        assert {r.text_sha256 for r in got if r.doc_id == 7} == {hashlib.sha256(b" ").hexdigest()}
    assert exact_dedup.drop_exact_copies(frame).count() == 6 and exact_dedup.exact_dedup(empty(spark)).count() == 0


def test_exact_dedup_merges_runs_in_rounds(spark, monkeypatch):
    """Many runs and cells, groups of very different size, and rounds that are cut apart."""
    monkeypatch.setattr(exact_dedup, "CELL", 7)
    monkeypatch.setattr(exact_dedup, "AT_ONCE", 2)
    rng = random.Random(13)
    rows = [(k, "hot" if k % 3 == 0 else f"t{rng.randrange(400)}") for k in range(1500)]
    rng.shuffle(rows)
    want: dict = {}
    for i, text in rows:
        want.setdefault(text, []).append(i)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(23)).collect()}
    for i, text in rows:
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(want[text]), len(want[text]), i == min(want[text]))


# --- 9


def brute_lines(rows, size=50):
    """Words left: without those of a line, or of ``size`` neighbouring words, that came before."""
    seen, lines_seen, out = set(), set(), {}
    for i, text in rows:
        w, gone, p = text.split(), set(), 0
        for line in text.split("\n"):
            if words := tuple(line.split()):
                if words in lines_seen:
                    gone.update(range(p, p + len(words)))
                lines_seen.add(words)
                p += len(words)
        for p in range(len(w) - size + 1):
            if (key := tuple(w[p : p + size])) in seen:
                gone.update(range(p, p + size))
            seen.add(key)
        out[i] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_lines_equal_brute_force(spark):
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(10**9)}"  # noqa: E731  no two places agree beyond a passage by chance
    passages = [[word() for _ in range(n)] for n in (32, 40, 49, 50, 51, 70, 200)]
    short = [" ".join(word() for _ in range(n)) for n in (1, 1, 2, 5, 20, 60)]
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    for k in range(80):
        text = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(1, 4)):
            text += rng.choice(passages) + [word() for _ in range(rng.randint(0, 30))]
        text = " ".join(text)
        for _ in range(rng.randint(0, 3)):
            text = f"{text}\n{rng.choice(short)}\n{' ' * rng.randint(0, 2)}{word()}"
        rows.append((10_000 + k, text))
    rows += [(20_000, " ".join(["again and again"] * 60)), (20_001, ""), (20_002, f"{short[0]}"), (20_003, f"{short[0]}\n\n{short[0]}"), (20_004, " \n ")]
    # contexts that agree on the left with one text and on the right with another
    left, middle, right = ([word() for _ in range(n)] for n in (30, 34, 30))
    rows += [(30_000, " ".join(left + middle + ["p"] * 3)), (30_001, " ".join(["q"] * 3 + middle + right)), (30_002, " ".join(left + middle + right)), (30_003, " ".join(["s"] + middle + right))]
    # passages inside longer ones that themselves repeat, at either side
    for k in range(12):
        inner, before, after = ([word() for _ in range(n)] for n in (60, 10, 12))
        rows += [(40_000 + 10 * k + j, " ".join([word(), *x, word()])) for j, x in enumerate((inner, before + inner, before + inner + after, before + inner, inner + after, before + inner + after))]
    # a very long text, and one that repeats a part of its middle
    long = [word() for _ in range(120_000)]
    rows += [(50_000, " ".join(long)), (50_001, " ".join(["x", *long[60_000:61_000], "y"]))]
    rows.sort()
    got = {r.doc_id: r for r in lines.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    for i, want in brute_lines(rows).items():
        assert got[i].text.split() == want, i
    assert all(got[i].removed_words == len(t.split()) - len(got[i].text.split()) for i, t in rows)


def test_lines_query_leaves_each_line_once(spark):
    kept = Counter(tuple(line.split()) for r in queries.op9_lines(spark, DIR).collect() for line in r.text.split("\n"))
    assert {n for line, n in kept.items() if line} == {1}


def test_line_starts_and_window_hashes_by_definition():
    """The first word after a break begins a line; equal windows of words, and only these, hash alike wherever they stand."""
    texts = ["", "\n\na b\n\nc", " ", "d\r\ne f\n", "g", "a b c " * 30]
    words, counts, starts = lines.hashed_words(texts, lines=True)
    told = [x.split() for x in texts]
    assert counts.tolist() == [len(x) for x in told] and len(words) == sum(map(len, told))
    assert starts.tolist() == [0, 2, 3, 4, 6, 7]
    assert lines.hashed_words(["", "\n"], lines=True)[2].tolist() == []
    base = int(counts[:-1].sum())
    at = np.arange(base, base + 40)
    found = lines._polynomials(words, at, at + lines.RUN)
    assert len(set(found.tolist())) == 3 and (found[3:] == found[:-3]).all()


def test_lines_odd_rows(spark):
    got = lines.drop_repeated_lines(odd_docs(spark).withColumn("removed_runs", F.lit("clash")).withColumn("text_hash", F.lit(1))).collect()
    assert len(got) == len(ODD) + 3 and {r.removed_words for r in got if r.doc_id == 0} == {0}
    assert [r.removed_words > 19_000 for r in got if r.doc_id == len(ODD) - 1] == [True]  # one word 20,000 times
    assert [r.text for r in got if r.doc_id == 3] == ["a  b"] * 3  # the rows of one document are cut alike
    assert lines.drop_repeated_lines(empty(spark)).count() == 0
    same = " ".join(f"k{n}" for n in range(60))
    twice = spark.createDataFrame([(1, "x\n" + same + "\ny"), (2, "a\n" + same + "\nb"), (None, same), (3, "c\r\nx\r\nd")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text) for r in lines.drop_repeated_lines(twice).collect()) == [(0, ""), (1, "x\n" + same + "\ny"), (2, "a\nb"), (3, "c\r\nd")]


# --- 10


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(10)
    data = rng.normal(size=(700, 12)).astype(np.float32)
    data[100:140] = data[5]  # ties
    rows = [(int(k), [float(x) for x in v]) for k, v in enumerate(data)] + [(40, [0.5] * 12), (1000, None), (1020, [float("nan")] * 12), (1040, [None] * 12), (None, [1.0] * 12), (1060, [1.0] * 7), (1080, [])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = topk.top_k(frame, F.col("vec_id") % 20 == 0, block=150, query_block=7).collect()
    good = [(i, np.floor(64 * np.array([*v, *[0] * (12 - len(v))], np.float64)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for n, (i, q) in enumerate(good):
        if i % 20 == 0:
            best = sorted((-int(q @ v), j) for m, (j, v) in enumerate(good) if m != n)[:20]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == sorted(want)
    assert topk.top_k(frame.limit(0), F.lit(True)).count() == 0


def test_topk_bounds_hold_and_prune():
    rng = np.random.default_rng(11)
    data, q = rng.integers(-250, 250, (3000, 64)), rng.integers(-250, 250, (40, 64))
    approximation = topk.Approximation.of(data)
    base, down, up = approximation.scan(q.astype(np.float64))
    exact = q @ data.T
    assert (base + down[:, None] <= exact).all() and (exact <= base + up[:, None]).all()
    least = np.partition(base, 2980, axis=1)[:, 2980]
    assert ((base >= (least + down - up)[:, None]).sum(1) < 300).all()  # a tenth is read at most


def test_topk_numbers_beyond_64_bits(spark):
    rows = [(0, [1e300, 1.0]), (20, [-1e300, 0.0]), (1, [1e300, 0.0]), (2, [1e15, 1e15]), (3, [0.5, 0.25])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    most, least = (1 << 63) - 1, -(1 << 63)
    comp = lambda v: [min(max(int(np.floor(64 * x)) if abs(x) < 1e18 else int(np.sign(x)) * 2**70, least), most) for x in v]
    for q in (0, 20):
        own = comp(dict(rows)[q])
        want = sorted((-min(max(sum(a * b for a, b in zip(own, comp(v), strict=True)), least), most), i) for i, v in rows if i != q)
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


# --- queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = con.execute(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, DIR).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None)))


def test_query_digests(spark, tokenizer):
    """The columns that the queries add to their operators, against plain Python."""
    rows = {r.doc_id: r.text for r in documents(spark).collect()}
    for r in queries.op1_bpe(spark, DIR).collect():
        ids = tokenizer.encode(rows[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    packed = queries.op4_packing(spark, DIR).toPandas()
    for doc_id, text in rows.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        mine = packed[packed.doc_id == doc_id].sort_values("piece")
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist() and mine.length.sum() == len(ids)
    near = queries.op5_minhash(spark, DIR).toPandas()
    assert len(near) == len(rows) and (near.kept == (near.doc_id == near.class_id)).all() and (near.groupby("class_id").doc_id.min() == near.groupby("class_id").class_id.first()).all()
    assert (near.groupby("class_id").doc_id.count() == near.groupby("class_id").class_size.first()).all()
    toxic = queries.op7_toxicity(spark, DIR).toPandas()
    assert sorted(toxic.doc_id) == sorted(rows) and toxic.score.between(0, 1).all() and (toxic.predicted == (toxic.score >= 0.5)).all()
    assert (toxic.held_out == [zlib.crc32(str(k).encode()) % 5 == 0 for k in toxic.doc_id]).all()
    for r in queries.op6_html(spark, DIR).collect():
        assert r.n_chars == len(r.text) > 0 and r.url


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, DIR)
        assert docs.columns == before.columns, name
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert len({" ".join(t.split()) for t in kept.values()}) == len(kept)
    assert {r.doc_id for r in corpus_pipeline.run(spark, DIR).collect()} == set(kept)


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    rows = [(k, x, None, "s", None, "clash", 1) for k, x in enumerate(ODD)] + [(None, "null id", "en", None, 7, "x", 2), (3, "a  b", "en", "s", 4, "y", 3), (3, "a  b", "en", "s", 4, "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, class_id int").repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, docs.limit(0), DIR)
        assert none.columns == docs.columns and none.count() == 0, name
        docs = stage(spark, docs, DIR)
        assert docs.columns == none.columns
    texts = [r.text or "" for r in docs.collect()]
    normal = {" ".join(t.split()) for t in texts}
    # empty texts, which have no words, are exact copies of one another or stand alone
    assert len([t for t in texts if t.strip()]) == len(normal - {""}) and "null id" in normal
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_pipeline_scores_once_and_packs_nothing_of_nothing(spark, monkeypatch):
    import corpus_pipeline

    assert corpus_pipeline.packed(spark, spark.read.parquet(f"{DIR}/documents.parquet").limit(0), DIR).count() == 0
    runs = []
    first = corpus_pipeline.STAGES[0][1]
    seen = spark.sparkContext.accumulator(0)

    def counted(spark_, docs, sf_dir):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        runs.append(1)
        out = first(spark_, docs, sf_dir)
        return out.mapInArrow(count, out.schema)

    monkeypatch.setattr(corpus_pipeline, "STAGES", [(corpus_pipeline.STAGES[0][0], counted), *corpus_pipeline.STAGES[1:]])
    out = corpus_pipeline.run(spark, DIR)
    assert out.count() > 0 and runs == [1]
    assert seen.value <= spark.read.parquet(f"{DIR}/documents.parquet").count()  # rows kept, each read once


def test_tokenizer_path_is_a_parameter():
    assert queries.TOKENIZER == public_tokenizers.path("byte_bpe_50k.json")
