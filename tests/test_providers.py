import pytest

from curatrix.sources import generators
from curatrix.sources.providers import FORMATS, ChatProvider, as_messages

TALK = [{"role": "system", "content": "Be brief."}, {"role": "user", "content": "Hi"}, {"role": "assistant", "content": "Hello"}, {"role": "user", "content": "Go on"}]
REPLIES = {
    "chat": {"choices": [{"message": {"content": "yes"}}], "usage": {"prompt_tokens": 5, "completion_tokens": 1}},
    "messages": {"content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "yes"}], "usage": {"input_tokens": 5, "output_tokens": 1}},
    "contents": {"candidates": [{"content": {"parts": [{"text": "y"}, {"text": "es"}]}}], "usageMetadata": {"promptTokenCount": 5, "candidatesTokenCount": 1}},
}


@pytest.mark.parametrize("provider", sorted(FORMATS))
def test_round_trip(provider):
    sent = []
    p = generators.create(provider, model="m", transport=lambda r: sent.append(r) or REPLIES[FORMATS[provider]])
    assert p.generate(TALK, 0.7) == ("yes", {"prompt_tokens": 5, "completion_tokens": 1, "provider": provider, "model": "m"})
    kind, r = FORMATS[provider], sent[0]
    if kind == "chat":
        assert r["messages"] == TALK and r["temperature"] == 0.7
    elif kind == "messages":
        assert r["system"] == "Be brief." and [m["role"] for m in r["messages"]] == ["user", "assistant", "user"] and r["max_tokens"] == 4000
    else:
        assert [c["role"] for c in r["contents"]] == ["user", "model", "user"] and r["systemInstruction"]["parts"][0]["text"] == "Be brief." and r["generationConfig"]["temperature"] == 0.7
    with pytest.raises(ValueError):
        p.reply({})


def test_thinking_sends_no_temperature():
    no = lambda r: {}
    deep = ChatProvider("anthropic", "m", no, thinking=9000).request("Hi")
    assert deep["thinking"]["budget_tokens"] == 9000 and "temperature" not in deep and "system" not in deep
    hard = ChatProvider("openai", "m", no, thinking="high")
    assert hard.request("Hi")["reasoning_effort"] == "high" and "temperature" not in hard.request("Hi") and hard.name == "m_thinking_high"
    assert as_messages("x", "s")[0] == {"role": "system", "content": "s"} and as_messages(TALK, "other")[0]["content"] == "Be brief."
    for wrong in (lambda: ChatProvider("nobody", "m", no), lambda: as_messages([{"role": "tool", "content": ""}]), lambda: generators.create("nobody")):
        with pytest.raises(ValueError):
            wrong()


def test_on_executors(spark):
    def make():
        from curatrix.sources.providers import ChatProvider

        seen = []

        def transport(request):
            seen.append(1)
            if len(seen) == 1:
                return {"choices": []}  # no text: asked again
            return {"choices": [{"message": {"content": request["messages"][-1]["content"].upper()}}], "usage": {"prompt_tokens": 1, "completion_tokens": 2}}

        return ChatProvider("openai", "m", transport)

    df = spark.createDataFrame([(i, f"say {i}") for i in range(6)], "i int, p string").coalesce(1)
    out = {r.i: r for r in generators.generate(df, "p", make, (0.2,), wait=0.0).collect()}
    assert {i: r.response for i, r in out.items()} == {i: f"SAY {i}" for i in range(6)} and max(r.attempts for r in out.values()) == 2
