"""The grammar of toxicity against a plain reading of its rules, and the bound on training labels."""

import random

from pyspark.sql import functions as F

from storystream.llm import toxicity as t


def plain(symbols, quoted):
    """Each rule looked up by slices around every head."""
    found = {}
    for at, (head, weight) in enumerate(symbols):
        if head not in (t.INSULT, t.THREAT):
            continue
        names = [s for s, _ in symbols]
        before, after = names[:at], names[at + 1 :]
        if t.NEGATION in before[-4:] or t.NEGATION in after[:1]:
            mood = "negated"
        elif t.REPORT in before or (before.count(t.QUOTE) + quoted) % 2 or t.REPORT in after[-3:]:
            mood = "reported"
        else:
            mood = "asserted"
        near = t.TARGET in after[:2]
        if head == t.INSULT:
            aimed = near or t.TARGET in before[-4:]
        else:
            # An intent among the six symbols before, and a target since the last one
            intents = [i for i in range(max(0, at - 6), at) if names[i] == t.INTENT]
            aimed = bool(intents) and (near or t.TARGET in names[intents[-1] + 1 : at])
        kind = head, mood, "aimed" if aimed else "loose"
        found[kind] = found.get(kind, 0) + weight
    return found


def test_machines_equal_the_plain_rules():
    rng, seen = random.Random(5), set()
    for _ in range(20_000):
        names = rng.choices(t.SYMBOLS, [3, 3, 2, 1, 1, 2, 1, 6], k=rng.randrange(14))
        symbols, quoted = [(s, rng.choice([0.5, 1.0])) for s in names], rng.randrange(2)
        expected = plain(symbols, quoted)
        assert t.read_clause(iter(symbols), quoted) == expected
        seen |= set(expected)
    assert seen == set(t.KINDS)


def kinds(text):
    model = t.Model(t._seed_words())
    return {k for k, v in zip(t.KINDS, t.matches(text, model, model.heads())) if v}


def test_threats_need_intent_verb_and_target():
    aimed = {(t.THREAT, "asserted", "aimed")}
    loose = {(t.THREAT, "asserted", "loose")}
    assert kinds("I will kill you") == kinds("Ich werde dich töten") == kinds("they must really hurt him") == aimed
    assert kinds("Kill the process") == kinds("we will kill the process") == kinds("you kill time") == loose
    assert kinds("I will not kill you") == {(t.THREAT, "negated", "aimed")}


def test_negation_and_report_on_both_sides():
    assert kinds("Du bist ein Idiot nicht") == kinds("you idiot, no") == {(t.INSULT, "negated", "aimed")}
    reported = {(t.INSULT, "reported", "aimed")}
    assert kinds("You are an idiot, he said.") == kinds('He: "I know. You are an idiot. Go"') == reported
    assert kinds('"I know. Go." You are an idiot') == {(t.INSULT, "asserted", "aimed")}
    # A mark that is never closed holds to the end of its line only
    assert kinds('5" long\nYou are an idiot') == {(t.INSULT, "asserted", "aimed")}


def test_loose_words_weigh_nothing_without_labels(spark):
    texts = [(1, "idiot " * 50), (2, "Kill the process. Shoot."), (3, "You are an idiot"), (4, ""), (5, None)]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    score = {r.doc_id: r.score for r in t.score_documents(docs, none).collect()}
    assert score[1] == score[2] == score[4] == score[5] < 0.1 and score[3] >= t.THRESHOLD


def test_labels_are_bounded_by_their_hashes(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    taken = {int(r.text) for r in t.training_rows(docs, labels, 500).collect()}
    usable = labels.where(~t.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).limit(500)
    assert taken == {r.doc_id for r in usable.collect()} and len(taken) == 500
