"""Event types, word lists and patterns that results have to agree on."""

# Event types of a report.
NOISY_TYPES = ["tty_output_chunk", "tty_input_chunk", "assistant_text_delta", "assistant_reasoning_delta", "codex_token_count"]
INCLUDED_TYPES = [
    "session_started", "session_ended", "user_input", "request_user_message", "assistant_text_final", "assistant_reasoning_final",
    "tool_call_requested", "tool_call_dispatched", "tool_call_stdout", "tool_call_stderr", "tool_call_result", "tool_call_error",
    "subagent_spawn_requested", "subagent_spawned", "subagent_message", "subagent_result", "subagent_resumed", "subagent_closed",
    "final_output", "claude_capture_mode", "claude_session_init", "codex_rollout_imported", "codex_turn_context", "codex_task_started",
    "codex_task_complete", "codex_turn_aborted", "codex_context_compacted", "openclaw_overlay_configured",
]
ONCE_BY_LINE_TYPES = ["request_user_message", "assistant_reasoning_final"]

# Event types of a case.
ACTION_TYPES = ["tool_call_requested"]
OUTPUT_TYPES = ["tool_call_result", "tool_call_stdout", "tool_call_stderr"]
SYSTEM_TYPES = ["request_system_message"]
EXECUTION_TYPES = ["tool_call_dispatched", "tool_call_result", "tool_call_stdout", "tool_call_stderr", "tool_call_error"]

# Event types of which one with the same call is enough.
KEYED_TYPES = [
    "tool_call_requested", "tool_call_dispatched", "tool_call_result", "subagent_spawn_requested", "subagent_spawned",
    "subagent_message", "subagent_result", "subagent_resumed", "subagent_closed",
]

# Types of blocks that hold text.
TEXT_BLOCKS = ["text", "input_text", "output_text"]

# Word lists of the hints.
WRITE_WORDS = [
    "edit", "modify", "change", "update", "fix", "write", "create", "add", "remove", "delete", "rename", "move", "push", "deploy",
    "install", "run", "execute", "send", "upload", "apply", "patch", "spawn", "close", "resume", "wait",
    "编辑", "修改", "变更", "更新", "修复", "写", "创建", "添加", "删除", "重命名", "移动", "推送", "部署", "安装", "运行", "执行",
    "发送", "上传", "应用", "关闭", "恢复", "等待",
]
IRREVERSIBLE_WORDS = ["delete", "remove", "force", "force-push", "reset", "wipe", "drop", "destroy", "删除", "移除", "强推", "覆盖", "重置", "清空", "销毁"]
READ_PREFIXES = ["pwd", "ls", "find", "cat", "sed", "grep", "rg", "head", "tail", "wc", "nl", "git status", "git log", "git show", "git diff", "python -c", "python3 -c"]
WRITE_PREFIXES = [
    "rm", "mv", "cp", "touch", "mkdir", "chmod", "chown", "git add", "git commit", "git push", "git reset", "git checkout", "git clean",
    "python", "python3", "bash", "sh", "make", "npm", "yarn", "pnpm", "pip", "apply_patch", "docker", "kubectl",
]
DESTRUCTIVE = ["rm -rf", "git push --force", "git push -f", "git reset --hard", "git clean -fd", "drop table"]
EXTERNAL = ["curl ", "wget ", "scp ", "rsync ", "ssh ", "http://", "https://"]
ACTION_KINDS = {
    "exec_command": "shell", "apply_patch": "patch", "spawn_agent": "delegate_spawn", "send_input": "delegate_message",
    "wait_agent": "delegate_wait", "resume_agent": "delegate_resume", "close_agent": "delegate_close",
}
DELEGATE_TOOLS = ["spawn_agent", "send_input", "wait_agent", "resume_agent", "close_agent"]

# Patterns, for Java's regular expressions.
SPACES = r"(?U)[\s\x1c-\x1f]+"
ANSI = r"\x1b\[[0-?]*[ -/]*[@-~]"
ENVIRONMENT = r"^\s*<environment_context>"
URL = r"""(https?://[^\s'"<>]+)"""
PATH = r"""((?<![A-Za-z0-9_])(?:~?/|\.\.?/)[^\s'"<>|;:,]+)"""
CUE = r"(?iU)\b(?:should|must|need to|run|execute|delete|remove|drop|send|upload|push|deploy|also)\b|(?:应该|需要|执行|删除|移除|发送|上传|推送|部署|另外)"

# Headers whose values are secret, and headers of one hop.
SECRET_HEADERS = ["authorization", "cookie", "x-api-key", "proxy-authorization", "set-cookie"]
HOP_HEADERS = ["connection", "keep-alive", "proxy-authenticate", "proxy-authorization", "proxy-connection", "te", "trailers", "transfer-encoding", "upgrade"]
