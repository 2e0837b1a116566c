"""Patterns of prompt injection and of what hides it: layers 1 to 5, in order."""

# Severity by type.
SEVERITY = {
    "prompt_injection": "critical",
    "system_role_injection": "critical",
    "delimiter_injection": "high",
    "jailbreak": "high",
    "persona_switch": "high",
    "hypothetical_bypass": "medium",
    "base64_payload": "high",
    "unicode_trick": "medium",
    "invisible_chars": "high",
    "homoglyph": "medium",
    "markdown_injection": "medium",
    "code_block_escape": "medium",
    "html_injection": "medium",
    "shell_command": "medium",
    "sql_injection": "medium",
    "code_execution": "medium",
}
# Fixed values: (layer, type, pattern, how it is made harmless). \b is a word boundary; all in any case.
THREATS = [
    (1, "prompt_injection", r"\b(?:ignore|disregard|forget|override|bypass|skip|discard)\s+(?:all\s+)?(?:previous|prior|above|earlier|your|the)?\s*(?:instructions?|rules?|guidelines?|constraints?|restrictions?|directions?|prompts?)\b", "escape"),
    (1, "prompt_injection", r"\bbypass\s+(?:your\s+)?(?:usual\s+)?(?:content\s+)?polic(?:y|ies)\b", "escape"),
    (1, "prompt_injection", r"\b(?:new\s+)?(?:system|user|assistant)\s*(?:prompt|message|instruction|role)\s*[:=]", "escape"),
    (1, "prompt_injection", r"\[\s*(?:SYSTEM|INST|ASSISTANT|USER)\s*\]|\<\s*(?:system|user|assistant)\s*\>", "escape"),
    (1, "prompt_injection", r"(?:^|\n)\s*(?:system|assistant|user)\s*:\s*(?=\S)", "escape"),
    (1, "system_role_injection", r"\byou\s+(?:are|will\s+be|must\s+act\s+as|should\s+act\s+as|must\s+be|are\s+now)\s+(?:a|an|the)?\s*(?:different|new|another|evil|unrestricted|unfiltered)\b", "escape"),
    (1, "system_role_injection", r"\bfrom\s+now\s+on\s*[,:]?\s*(?:you|your|act|behave|respond|operate)\b", "escape"),
    (1, "system_role_injection", r"\benter(?:ing)?\s+(?:into\s+)?(?:a\s+)?(?:new|different|special|developer|admin|root|debug)\s+mode\b", "escape"),
    (1, "delimiter_injection", r"(?:---+|===+|\*\*\*+|####+)\s*(?:END|BEGIN|START|STOP|NEW|IGNORE|SYSTEM|ACTUAL|REAL)\s*(?:OF\s+)?(?:INSTRUCTIONS?|PROMPT|CONTEXT|MESSAGE|INPUT|OUTPUT)?\s*(?:---+|===+|\*\*\*+|####+)?", "escape"),
    (1, "delimiter_injection", r"#{3,}\s*(?:SYSTEM|USER|ASSISTANT)(?:\s+PROMPT)?\s*#{3,}", "escape"),
    (1, "delimiter_injection", r"<\|(?:endoftext|im_start|im_end|sep|pad|unk|mask|cls|start|end)\|>", "strip"),
    (2, "jailbreak", r"\b(?:DAN|DAM|DUDE|KEVIN|STAN|MONGO|ARIA)\s*(?:mode|prompt|jailbreak)?\b", "escape"),
    (2, "jailbreak", r"\bdo\s+anything\s+now\b|\bunrestricted\s+(?:mode|AI|assistant|model)\b", "escape"),
    (2, "jailbreak", r"\b(?:without|no|remove|disable|turn\s+off|ignore)\s+(?:all\s+)?(?:any\s+)?(?:your\s+)?(?:ethical|safety|content|moral)?\s*(?:filter|restriction|limitation|guideline|constraint|safeguard|guardrail)s?\b", "escape"),
    (2, "jailbreak", r"\b(?:jailbreak|jailbroken|broken\s+free|escaped|liberated)\s*(?:mode|version|state|AI|model|assistant)?\b", "escape"),
    (2, "persona_switch", r"\bpretend\s+(?:to\s+be|you(?:'re|\s+are))\s+(?:a|an)?\s*(?:evil|malicious|unethical|unrestricted|uncensored|criminal|hacker)\b", "escape"),
    (2, "persona_switch", r"\broleplay\s+(?:as\s+)?(?:a|an)?\s*(?:villain|criminal|hacker|attacker|evil|malicious|bad\s+actor)\b", "escape"),
    (2, "hypothetical_bypass", r"\b(?:hypothetically|theoretically|in\s+theory|imagine\s+if|what\s+if)\s+(?:you\s+)?(?:could|would|were\s+able\s+to|had\s+no\s+restrictions?)\b", "escape"),
    (2, "hypothetical_bypass", r"\bfor\s+(?:educational|research|academic|training|testing)\s+purposes?\s+only\b", "escape"),
    (3, "base64_payload", r"\b(?:base64|b64|hex|rot13|unicode|url)[\s_-]*(?:encode|decode|encoded|decoded)?\s*[:=]", "escape"),
    (3, "unicode_trick", r"\\x[0-9a-fA-F]{2}(?:\\x[0-9a-fA-F]{2}){5,}", "strip"),
    (3, "unicode_trick", r"\\u[0-9a-fA-F]{4}(?:\\u[0-9a-fA-F]{4}){3,}", "strip"),
    (3, "unicode_trick", r"&#x?[0-9a-fA-F]+;(?:&#x?[0-9a-fA-F]+;){3,}", "strip"),
    (4, "markdown_injection", r"\[(?:system|admin|root|inject|execute)\]\s*\([^)]*\)", "escape"),
    (4, "markdown_injection", r"!\[(?:system|inject|execute|run|cmd)\]\s*\([^)]*\)", "escape"),
    (4, "code_block_escape", r"```\s*(?:system|bash|sh|cmd|powershell|exec|eval)\s*\n", "escape"),
    (4, "code_block_escape", r"```\s*\n[^`]*(?:ignore|override|bypass|new\s+instructions)[^`]*\n```", "escape"),
    (4, "html_injection", r"<\s*(?:script|iframe|object|embed|form|input|style|link|meta|base)\b[^>]*>", "strip"),
    (4, "html_injection", r"\bon\w+\s*=\s*[\"'][^\"']*[\"']", "strip"),
    (5, "shell_command", r"(?:^|\s)(?:sudo|chmod|chown|rm\s+-rf|wget|curl|nc|netcat|bash\s+-c|sh\s+-c)\s", "escape"),
    (5, "shell_command", r"\$\((?:curl|wget|nc|bash|sh|python|perl|ruby|exec|eval)[^)]*\)", "escape"),
    (5, "shell_command", r"`(?:curl|wget|nc|bash|sh|python|perl|ruby|exec|eval)[^`]*`", "escape"),
    (5, "sql_injection", r"\b(?:SELECT|INSERT|UPDATE|DELETE|DROP|UNION|ALTER)\s+.*?(?:FROM|INTO|TABLE|WHERE|SET)\b", "escape"),
    (5, "sql_injection", r"['\"]?\s*(?:OR|AND)\s+['\"]?\d+['\"]?\s*=\s*['\"]?\d+['\"]?", "escape"),
    (5, "code_execution", r"\b(?:eval|exec|compile|__import__|getattr|setattr|globals|locals)\s*\(", "escape"),
    (5, "code_execution", r"\b(?:Function|eval|setTimeout|setInterval)\s*\([^)]*\)", "escape"),
]
BASE64 = r"(?:[A-Za-z0-9+/]{4}){10,}(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=|[A-Za-z0-9+/]{4})"
INVISIBLE = "​‌‍⁠⁡⁢⁣⁤﻿­͏᠎⠀"
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "Α": "A", "Β": "B", "Ε": "E",
    "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Χ": "X", "Υ": "Y", "З": "Z",
}
#: The layers that a strictness looks at, and whether invisible characters and homoglyphs count.
STRICTNESS = {"low": (3, False, False), "medium": (4, True, False), "high": (5, True, True)}
