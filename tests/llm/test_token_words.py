"""Words with marks behind them are encoded in two parts, each known from before; the ids are the tokenizer's."""

import numpy as np
import public_tokenizers

from lakeward.llm.token_files import WordEncoder


def test_marks_behind_a_word_need_no_whole_tokenizer(monkeypatch):
    encoder = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    words = ["Hesh$$$", "thing###", "Über,%%%", "élève.&", "a*.", "b#,$.%*&", "c", "d."]
    odd = ["it's", "x's$", "$5", "a#b", "don't.", "é#", "7%", "ß...", "<|endoftext|>", "ab" * 40 + "##"]
    ids = lambda x: encoder.tokenizer.encode(x, add_special_tokens=False).ids
    for x in words + odd + [" ".join(words + odd)]:
        assert np.frombuffer(encoder.text(x), encoder.kind).tolist() == ids(x), x
    seen, direct = [], encoder.direct
    monkeypatch.setattr(encoder, "direct", lambda x: seen.append(x) or direct(x))
    for x in ("Newword$$$", "otherword###", "thirdword,%%%"):
        assert np.frombuffer(encoder.text(x), encoder.kind).tolist() == ids(x)
    assert not seen
