import json

import pytest
from pyspark.sql import functions as F

from loomtrace.plans import messages


@pytest.fixture
def types(spark):
    def run(function, *payloads, raw="payload"):
        rows = [(k, p if isinstance(p, str) else json.dumps(p)) for k, p in enumerate(payloads)]
        df = spark.createDataFrame(rows, "key long, text string")
        df = df.select("key", F.parse_json("text").alias("payload")) if raw == "payload" else df.withColumnRenamed("text", "body")
        found = function(df).orderBy("key", "item", "emit").collect()
        return [[(r.event_type, json.loads(r.content)) for r in found if r.key == k] for k in range(len(payloads))]

    return run


def names(found):
    return [kind for kind, _ in found]


def test_requests_of_three_dialects(types):
    chat = {"model": "m", "system": "s", "messages": [{"role": "user", "content": ""}, {"role": "tool", "content": "out", "tool_call_id": "c", "name": "n"}, {"role": "x", "content": [{"type": "text", "text": "a"}, "b"]}]}
    blocks = {"anthropic-version": "1", "system": [{"type": "text", "text": "rules"}], "messages": [
        {"role": "user", "content": "hi"}, {"role": "assistant", "content": [{"type": "text", "text": "t1"}, {"type": "thinking", "thinking": "hm"}, {"type": "tool_use", "id": "c1", "name": "spawn_agent", "input": {"agent_type": "w"}}, {"type": "text", "text": "t2"}]},
        {"role": "user", "content": [{"type": "tool_result", "tool_use_id": "c1", "content": [{"type": "text", "text": "done"}], "is_error": True}]}]}
    items = {"model": "m", "instructions": "obey", "input": [
        {"type": "message", "role": "developer", "content": [{"type": "input_text", "text": "dev"}]}, {"type": "message", "role": "user", "content": "u"}, {"type": "reasoning", "summary": [{"type": "text", "text": "s"}], "encrypted_content": "x"},
        {"type": "function_call", "name": "send_input", "call_id": "c1", "arguments": '{"target": "a1", "message": "go"}'}, {"type": "function_call_output", "call_id": "c1", "output": "ok"},
        {"type": "function_call_output", "call_id": "c9", "output": "lost", "name": "own"}]}
    first, second, third, none = types(messages.requests, chat, blocks, items, [1])
    assert names(first) == ["request_system_message", "request_user_message", "tool_call_result_attached", "request_message"]
    assert first[2][1] == {"message_index": 1, "role": "tool", "text": "out", "tool_call_id": "c", "name": "n"} and first[3][1]["text"] == "a\nb"
    assert names(second) == ["request_system_message", "request_user_message", "assistant_reasoning_final", "tool_call_requested", "subagent_spawn_requested", "request_assistant_message", "tool_call_result_attached"]
    assert second[3][1]["arguments"] == {"agent_type": "w"} and second[5][1]["text"] == "t1\nt2" and second[6][1]["output"] == "done" and second[6][1]["is_error"] is True
    assert names(third) == ["request_system_message", "request_system_message", "request_user_message", "assistant_reasoning_final", "tool_call_dispatched", "subagent_message", "tool_call_result", "subagent_message", "tool_call_result"]
    assert third[5][1]["delivery_state"] == "dispatched" and third[7][1]["delivery_state"] == "acknowledged" and third[7][1]["target_agent_id"] == "a1" and third[6][1]["tool_name"] == "send_input" and third[8][1]["tool_name"] == "own"
    assert none == []


def test_responses_of_three_dialects(types):
    chat = {"model": "m", "choices": [{"message": {"content": "hi", "reasoning": "why", "tool_calls": [{"id": "c", "function": {"name": "f", "arguments": '{"a": 1}'}}]}}, {"message": {"content": None}}]}
    blocks = {"model": "m", "content": [{"type": "redacted_thinking", "data": "x"}, {"type": "tool_use", "id": "c", "name": "f", "input": {}}, {"type": "text", "text": "t"}]}
    items = {"object": "response", "output": [{"type": "reasoning"}, {"type": "message", "id": "m1", "content": [{"type": "output_text", "text": "t"}]}, {"type": "function_call", "call_id": "c", "name": "f", "arguments": "not json"}]}
    first, second, third = types(messages.responses, chat, blocks, items)
    assert names(first) == ["assistant_text_final", "assistant_reasoning_final", "tool_call_requested"] and first[2][1]["arguments"] == {"a": 1}
    assert names(second) == ["assistant_reasoning_final", "tool_call_requested", "assistant_text_final"] and second[0][1]["has_encrypted_content"] is True
    assert names(third) == ["assistant_text_final", "tool_call_requested"] and third[1][1]["arguments"] == "not json" and third[0][1] == {"output_index": 1, "text": "t", "item_id": "m1"}


def sse(*events):
    return "\n\n".join(f"event: {name}\ndata: {json.dumps({'type': name} | data)}" for name, data in events) + "\n\ndata: [DONE]\n\n"


def test_streams(types):
    message = {"type": "message", "id": "i", "role": "assistant", "content": [{"type": "output_text", "text": "hello"}]}
    items = sse(("response.output_text.delta", {"delta": "he", "item_id": "i"}), ("response.output_text.done", {"text": "hello", "item_id": "i"}), ("response.output_item.done", {"item": message}), ("response.output_item.done", {"item": message | {"id": "other"}}), ("response.output_item.done", {"item": {"type": "function_call", "call_id": "c", "name": "spawn_agent", "arguments": "{}"}}), ("response.completed", {"response": {"output": [message]}}))
    blocks = sse(
        ("message_start", {"message": {"model": "m"}}), ("content_block_start", {"index": 0, "content_block": {"type": "thinking", "thinking": ""}}), ("content_block_start", {"index": 1, "content_block": {"type": "tool_use", "id": "c", "name": "f"}}),
        ("content_block_delta", {"index": 0, "delta": {"type": "thinking_delta", "thinking": "h"}}), ("content_block_delta", {"index": 1, "delta": {"type": "input_json_delta", "partial_json": '{"a"'}}), ("content_block_delta", {"index": 0, "delta": {"type": "thinking_delta", "thinking": "m "}}), ("content_block_stop", {"index": 0}),
        ("content_block_delta", {"index": 1, "delta": {"type": "input_json_delta", "partial_json": ": 1}"}}), ("content_block_stop", {"index": 1}), ("content_block_start", {"index": 0, "content_block": {"type": "text", "text": "a"}}), ("content_block_delta", {"index": 0, "delta": {"type": "text_delta", "text": "b"}}), ("content_block_stop", {"index": 0}),
        ("content_block_start", {"index": 2, "content_block": {"type": "text", "text": "unfinished"}}),
    ).replace("\n", "\r\n")
    first, second, chat = types(messages.response_streams, items, blocks, 'data: {"choices": []}\n\n', raw="body")
    assert names(first) == ["assistant_text_delta", "assistant_text_final", "assistant_text_final", "tool_call_requested", "subagent_spawn_requested", "assistant_text_final"]
    assert second == [("assistant_reasoning_final", {"block_index": 0, "text": "hm"}), ("tool_call_requested", {"block_index": 1, "tool_call_id": "c", "tool_name": "f", "arguments": {"a": 1}}), ("assistant_text_final", {"block_index": 0, "text": "ab"})]
    assert chat == []


def test_transcripts_and_cache_rows(types):
    found = types(messages.agent_messages, {"type": "assistant", "message": {"role": "assistant", "content": [{"type": "tool_use", "id": "c", "name": "f", "input": {"x": 1}}, {"type": "text", "text": "t"}]}}, {"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "c", "content": "r"}]}}, {"type": "result", "result": "end"}, {"type": "system", "subtype": "init", "model": "m"}, {"type": "result", "result": " "})
    assert [names(f) for f in found] == [["tool_call_requested", "assistant_text_final"], ["tool_call_result"], ["final_output"], ["claude_session_init"], []]
    assert found[3][0][1] == {"subtype": "init", "model": "m"}
    (row,) = types(messages.cache_rows, {"model": "m", "system": [{"type": "text", "text": "s"}], "messages": [{"role": "user", "content": "u"}], "prompt": "p"})
    assert names(row) == ["request_system_message", "request_user_message", "request_system_message"] and row[2][1] == {"text": "p"}
