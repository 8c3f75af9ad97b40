import hashlib

from hypothesis import given
from hypothesis import strategies as st

from weirflow.llm import chat

DATA = "/root/testdata"

PARTS = st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "<<", ">>", "\\", " ", "a", "é", "\n", "< ", "<</>>", "[", "/"]), max_size=8).map("".join)


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def marked(text):
    return any(m in text for m in ("<s>", "</s>", "[INST]", "[/INST]", "<<", ">>"))


@given(PARTS)
def test_escapes_are_reversible_and_hide_control_strings(text):
    assert chat.unescape(chat.escape(text)) == text and not marked(chat.escape(text))


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool >> x"]), PARTS), max_size=7))
def test_round_trip_and_spans(turns):
    made = chat.format_turns(turns)
    assert made.text == chat.render_turns(turns) and chat.parse_turns(made.text) == turns and not made.rewritten_by
    assert [a for a, _ in made.spans] == [3, *(b for _, b in made.spans)][: len(turns)] and (not turns or made.spans[-1][1] == len(made.text))
    assert [chat.unescape(made.text[a:b]) for a, b in made.loss] == [t for r, t in turns if r == "assistant"]


def test_a_foreign_template_is_located_by_its_output():
    def render(turns):
        return "".join(f"<|{r}|>{t.strip()}\n" for r, t in turns)

    made = chat.format_turns([("user", "hi"), ("assistant", "hello"), ("user", "x")], render)
    assert [made.text[a:b] for a, b in made.spans] == ["<|user|>hi\n", "<|assistant|>hello\n", "<|user|>x\n"]
    assert [made.text[a:b] for a, b in made.loss] == ["hello"]


def test_rewriting_templates_are_found():
    def last_only(turns):  # earlier answers are dropped once another turn comes
        return "".join(f"[{r}]{'' if r == 'assistant' and k < len(turns) - 1 else t};" for k, (r, t) in enumerate(turns))

    def count_first(turns):
        return f"({len(turns)})" + "".join(f"{r}:{t};" for r, t in turns)

    turns = [("user", "a"), ("assistant", "bcd"), ("user", "e"), ("assistant", "f")]
    for render in (last_only, count_first):
        made = chat.format_turns(turns, render)
        assert made.rewritten_by and made.loss == []


def test_query(spark):
    rows = spark.read.parquet(f"{DATA}/sf0.01/conversations.parquet").orderBy("conv_id", "turn").collect()
    talks: dict = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in rows:
        talks.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in chat.op9_chat_format(spark, f"{DATA}/sf0.01").collect()}
    assert set(got) == set(talks)
    for i, turns in talks.items():
        learned = "".join(t for r, t in turns if r == "assistant")
        r = got[i]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), digest(turns), len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r["formatted_chars"] == len(chat.render_turns(turns)) and not r["rewrites_history"]


def test_edge_rows(spark):
    schema = "conv_id long, turn long, role string, text string, n_turns string"
    rows = [(1, 2, "assistant", None, "x"), (1, 1, "user", "q", "x"), (2, 1, None, "t", "x"), (2, 1, None, "t", "x"), (None, 1, "user", "n", "x"), (3, None, "user", "a", "x"), (3, 0, "user", "b", "x")]
    df = spark.createDataFrame(rows, schema)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"]) for r in chat.format_conversations(df).collect()}
    assert got == {1: (2, digest([("user", "q"), ("assistant", "")]), 0), 2: (2, digest([("", "t")] * 2), 0), None: (1, digest([("user", "n")]), 0), 3: (2, digest([("user", "a"), ("user", "b")]), 0)}
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_long_conversations_stream_through(spark):
    rows = [(7, k, "assistant" if k % 2 else "user", f"text {k} </s>") for k in range(101)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    r = chat.format_conversations(df, max_turns=10).first()
    turns = [(role, text) for _, _, role, text in rows]
    learned = "".join(t for role, t in turns if role == "assistant")
    assert (r["n_turns"], r["turns_sha256"], r["loss_sha256"]) == (101, digest(turns), hashlib.sha256(learned.encode()).hexdigest())


def joined(out):
    """Texts, spans, loss spans and rewriting turns of whole conversations."""
    made: dict = {}
    for r in sorted(out.collect(), key=lambda r: r["segment"]):
        text, spans, loss, rewritten = made.setdefault(r["conv_id"], ([], [], [], []))
        assert r["begin"] == sum(map(len, text)) and r["first_turn"] == len(spans)
        text.append(r["text"])
        spans += [tuple(s) for s in r["spans"]]
        loss += [tuple(s) for s in r["loss"]]
        rewritten += r["rewritten_by"]
    return {i: ("".join(m[0]), *m[1:]) for i, m in made.items()}


TALK = [(7, k, ("user", "assistant", "assistant", "tool")[k % 4], f"text {k} </s>") for k in range(23)]


def test_segments_are_one_conversation(spark):
    """However many turns a segment has, text, spans and digests are those of the whole."""
    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").repartition(3)
    turns = [(role, text) for _, _, role, text in TALK]
    want = chat.format_turns(turns)
    for size in (1, 2, 5, 22, 23, 24):
        text, spans, loss, rewritten = joined(chat.render_conversations(df, max_turns=size))[7]
        assert (text, spans, loss, rewritten) == (want.text, want.spans, want.loss, []) and chat.parse_turns(text) == turns
        r = chat.format_conversations(df, max_turns=size).first()
        assert (r["n_turns"], r["turns_sha256"], r["formatted_chars"]) == (23, digest(turns), len(chat.render_turns(turns)))


def test_foreign_templates_get_the_whole_history(spark):
    def forgets(turns):  # the first turn goes when the twentieth comes
        return "".join(f"|{r}|{t}\n" for r, t in (turns[1:] if len(turns) >= 20 else turns))

    def keeps(turns):
        return "".join(f"|{r}|{t}\n" for r, t in turns)

    df = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").repartition(3)
    turns = [(role, text) for _, _, role, text in TALK]
    text, _, loss, rewritten = joined(chat.render_conversations(df, forgets, max_turns=5))[7]
    assert text == forgets(turns) and rewritten == [19] and loss == []
    text, spans, loss, rewritten = joined(chat.render_conversations(df, keeps, learned=("tool",), max_turns=5))[7]
    assert text == keeps(turns) and not rewritten and [text[a:b] for a, b in spans] == [keeps([t]) for t in turns]
    assert [text[a:b] for a, b in loss] == [t for r, t in turns if r == "tool"]
