"""What an encoder keeps, and ids whatever it keeps."""

import pyarrow as pa

from quarry.llm import text_ids


def test_few_parts_are_kept(monkeypatch):
    monkeypatch.setattr(text_ids, "PARTS", 40)
    monkeypatch.setattr(text_ids, "LEARNED", 20)
    path = text_ids.tokenizer_file()
    encoder = text_ids.TextEncoder(path)
    texts = [" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}x, Öl{k}" for k in range(a, a + 60)) for a in range(0, 480, 60)]
    for _ in range(2):
        ids, bounds = encoder(pa.array([*texts, None]), 1)
        assert len(encoder.parts) <= 40 + 5 * 20
        for k, t in enumerate([*texts, ""]):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == [*encoder.tokenizer.encode(t, add_special_tokens=False).ids, 1]
