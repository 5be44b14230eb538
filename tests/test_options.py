from __future__ import annotations

import pytest

from askloom.options import ChatOptions, ChunkOptions, PreviewOptions, SamplingOptions, SearchOptions, check_subtitle_lang


@pytest.mark.parametrize(
    "make",
    [
        lambda: ChunkOptions(max_characters=1),
        lambda: ChunkOptions(overlap=-1),
        lambda: ChunkOptions(max_characters=100, overlap=100),
        lambda: ChunkOptions(chunking_strategy="by_page"),
        lambda: SearchOptions(n_results=0),
        lambda: SearchOptions(n_results="some"),
        lambda: SearchOptions(max_distance=float("nan")),
        lambda: SearchOptions(space="hamming"),
        lambda: SamplingOptions(top_k=-1),
        lambda: SamplingOptions(temperature=-0.1),
        lambda: ChatOptions(history_len=-1),
        lambda: PreviewOptions(max_lines=-2),
        lambda: check_subtitle_lang(" "),
    ],
)
def test_out_of_range(make):
    with pytest.raises(ValueError):
        make()


def test_no_range_beyond_what_the_operators_need():
    assert ChunkOptions(max_characters=4000, new_after_n_chars=3000, overlap=500).soft == 3000
    assert SearchOptions(n_results=10, max_distance=5).k == 10
    assert ChatOptions(history_len=40).history_len == 40
    assert PreviewOptions(max_lines=100_000).max_lines == 100_000


def test_defaults_and_soft_limit():
    assert (ChunkOptions().max_characters, ChunkOptions().new_after_n_chars) == (800, 500)
    assert ChunkOptions(max_characters=100).soft == 100
    assert SearchOptions(n_results="max").k is None
