import hashlib

from quillstone.llm import chat


def test_digests_come_from_one_example_a_reply(spark):
    """Two replies and a turn after the last: formatted_chars counts each example with its whole context."""
    said = [("user", "a|b"), ("assistant", "one <|im_end|>"), ("user", "more"), ("assistant", "two"), ("user", "bye")]
    rows = [(c, k, r, t) for c in (1, None) for k, (r, t) in enumerate(said)] + [(2, 0, "user", "alone")]
    turns = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    full = {(r.conv_id, r.example): r for r in chat.expand(turns).collect()}
    read = chat.read_examples(chat.conversation_texts(turns), chat.write_examples(turns)).collect()
    assert len(read) == len(full) == 4
    for r in read:
        whole = full[r.conv_id, r.example]
        context = "".join(x.formatted for x in turns.orderBy("seq").collect() if x.conv_id == r.conv_id and x.seq < 2 * r.example + 1)
        assert whole.text.startswith(context) and r.context_sha256 == hashlib.sha256(context.encode()).hexdigest()
        assert r.chars == len(whole.text) and r.loss == ("one <|im_end|>", "two")[r.example]
    got = {r.conv_id: r for r in chat.conversation_digests(turns).collect()}
    for c in (1, None):
        assert got[c].formatted_chars == sum(len(r.text) for (k, _), r in full.items() if k == c) and (got[c].n_examples, got[c].n_turns) == (2, 5)
    assert (got[2].n_turns, got[2].n_examples, got[2].formatted_chars, got[2].loss_chars) == (1, 0, 0, 0)
