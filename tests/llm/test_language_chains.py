import numpy as np
import pytest
from tallyfield.llm import chain, language


@pytest.mark.parametrize("block", [1, 2, 7, 64])
def test_blocks_equal_whole_chains(block):
    rng = np.random.default_rng(block)
    size = [1, 2, 63, 64, 65, 128, 129, 700, 3]
    text = np.repeat(np.arange(len(size)), size)
    emit, trans = 3 * rng.normal(size=(len(text), 4)), 3 * rng.normal(size=(4, 4))
    got, pairs = chain.whole_marginals(emit, text, trans, block)
    total = 0
    for i, n in enumerate(size):
        _, post, moves = chain.forward_backward(emit[text == i][:, None], trans, np.array([n]))
        assert np.allclose(got[text == i], post[:, 0])
        total = total + moves
    assert np.allclose(pairs, total)


WORDS = {"en": "the of and that with this from other there which have been their", "de": "der die und nicht sich eine auch werden über nach wird sind einen", "es": "que los del las por con una para está como pero sus más"}


def mixed(rng, changes, run):
    """A text whose words are of one language for ``run`` words and then of another."""
    out, lang = [], "en"
    for _ in range(changes):
        lang = rng.choice([x for x in WORDS if x != lang])
        out += [(w, lang) for w in rng.choice(WORDS[lang].split(), run)]
    return out


def test_words_of_long_code_switched_texts():
    rng = np.random.default_rng(4)
    names = sorted(WORDS)
    texts, langs = zip(*((" ".join(rng.choice(WORDS[x].split(), 60)), x) for x in names for _ in range(40)))
    weights, trans = language.fit_texts(list(texts), np.array([names.index(x) for x in langs]), 3)
    for run in (6, 40, 500):
        words = mixed(rng, 1 + 1500 // run, run)
        post = language.word_marginals(language.words_of([" ".join(w for w, _ in words)]), weights, trans)
        assert np.mean(post.argmax(1) == [names.index(x) for _, x in words]) > 0.97
    assert np.all(trans.diagonal() > trans.min(1))


def test_many_junk_languages_are_bounded(spark):
    rows = [(f"junk {i}", f"x{i:05}") for i in range(3000)] + [(f"{t} {i}a", lang) for lang, t in WORDS.items() for i in range(30)]
    model = language.fit(spark.createDataFrame(rows, "text string, lang string"), languages=5)
    assert model.languages == ("de", "en", "es", "x00000", "x00001") and model.weights.shape == (language.WIDTH, 5)
