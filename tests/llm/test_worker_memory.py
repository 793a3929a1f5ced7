"""What Python workers keep from task to task."""

from brindle.llm import language, neardup, packing, substrings
from brindle.llm.queries import tokenizer_path


def test_a_worker_keeps_one_operators_tables():
    texts = {"en": "the quick brown fox jumps over the lazy dog", "de": "der schnelle braune Fuchs springt"}
    use = {
        "language": lambda: language._automata(texts).identify(["the lazy fox", "der Fuchs", None, ""]),
        "neardup": lambda: neardup.shingles("one two three four five six", 2).tolist(),
        "substrings": lambda: substrings.grams(b"one two three four five six".split()).tolist(),
        "packing": lambda: [blob for blob, _ in packing.word_tokens(tokenizer_path()).documents(["one two three", None])],
    }
    kept = {
        "language": language._MODEL, "neardup": neardup._KNOWN, "substrings": substrings._KNOWN, "packing": packing._TOKENS,
    }
    first = {}
    for name in [*use, *reversed(use)]:
        found = use[name]()
        assert first.setdefault(name, found) == found
        assert [k for k, v in kept.items() if v] == [name]


def test_a_worker_keeps_its_operators_table_from_task_to_task():
    texts = {"en": "the quick brown fox", "de": "der schnelle braune Fuchs"}
    assert language._automata(texts) is language._automata(dict(texts))
    assert language._automata(texts) is not language._automata({"en": "another text"})
    assert packing.word_tokens(tokenizer_path()) is packing.word_tokens(tokenizer_path())
