"""Word lists, templates and patterns that results depend on."""

# Characters removed before embedding text.
CONTROL_CHARS = "".join(chr(c) for c in [*range(0x01, 0x09), 0x0E, 0x0F, *range(0x11, 0x1C)])
SOFT_HYPHEN = "\u00ad"

# Characters mapped to one plain character.
BLANK_CHARS = "\u000b\u000c\u0085"
HYPHEN_CHARS = "\u2010\u2011\u2043\u2012\u2013\u2014\u2015\u2212\uff0d\u207b"
DOUBLE_QUOTE_CHARS = "\u201c\u201d\u201e\u201f"
SINGLE_QUOTE_CHARS = "\u2018\u2019\u201a\u201b\u055a\ua78b\ua78c\uff07`\u00b4\u2032\u2035"
SLASH_CHARS = "\u2044\u2215"

# Characters mapped to several plain characters, in this order.
EXPANSIONS = [
    ("\u2033", "''"),
    ("\u2036", "''"),
    ("\u2034", "'''"),
    ("\u2037", "'''"),
    ("\u2057", "''''"),
    ("\u2026", "..."),
    (" . . . ", " ... "),
]

# Characters that count as white space around and between words.
WHITE_SPACE = "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680" + "".join(
    map(chr, [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)

# Articles deleted from answers.
ARTICLES = ("a", "an", "the")

# Control tokens removed from generated text.
CONTROL_TOKENS = [
    "[Fully supported]",
    "[Partially supported]",
    "[No support / Contradictory]",
    "[No Retrieval]",
    "[Retrieval]",
    "[Irrelevant]",
    "[Relevant]",
    "<paragraph>",
    "</paragraph>",
    "[Utility:1]",
    "[Utility:2]",
    "[Utility:3]",
    "[Utility:4]",
    "[Utility:5]",
]
END_TOKEN = "</s>"

# Patterns.
SECTION_OPENING = r"((\d+\.)+|\*)\s+(##\s)?([^\n]+?)(:\s|\n+)"
SECTION_PATTERN = SECTION_OPENING + "(.*)"
LETTER_PATTERN = r"is[^\p{L}\p{N}_]+([A-E])[^\p{L}\p{N}_]+"
TOKEN_PATTERN = r"[\p{L}\p{N}\p{M}]+|[^\p{Z}\p{C}]"
DOCUMENT_BREAK = "\n---\n"
NO_TITLE = "(No Title)"

# Prompt templates.
PROMPT_TEMPLATES = {
    "prompt_input": "### Instruction:\n{instruction}\n\n### Input:\n{input}\n\n### Response:\n",
    "prompt_no_input": "### Instruction:\n{instruction}\n\n### Response:\n",
    "prompt_no_input_retrieval": (
        "Below is an instruction that describes a task. "
        "Write a response that appropriately completes the request.\n\n"
        "### Paragraph:\n{paragraph}\n\n### Instruction:\n{instruction}\n\n### Response:"
    ),
    "prompt_open_instruct": "<user>\n{instruction}\n<assistant>\n",
    "prompt_open_instruct_retrieval": "<user>\nReference:{paragraph}\n{instruction}\n<assistant>\n",
    "prompt_recomp_abstractive": "Question: {question}\n Document: {context}\n Summary: ",
    "llama_chat_prompt": "[INST]{instruction}[/INST]",
    "llama_chat_prompt_retrieval": "[INST]{paragraph}\n{instruction}[/INST]",
    "prompt_extract_lora": "[INST]<<SYS>>[MONITOR]{context}<</SYS>>{question}[/INST] ",
    "prompt_extract_prefix": "[INST]<<SYS>>{context}<</SYS>>{question}[/INST] ",
    "prompt_downstream_lora": "[INST]<<SYS>>[EXECUTOR]{context}<</SYS>>{question}[/INST] ",
    "prompt_downstream_prefix": "[INST]<<SYS>>{context}<</SYS>>{question}[/INST] ",
}

# User and system texts of the chat form.
QUOTE_REQUEST = '{task_type}: {question}\nDocument (multiple documents are separated by "---"):\n{context}'

QUOTE_RULES = """
Rule of labelling sections: if the fact of the first dummy quote "aaa" from a document with title "## AAA" is consistent with that of the second dummy quote "bbb" from a document with title "## BBB", and they contradict to that of the third dummy quote "ccc" from a document with title "## CCC", then label them as:
```
1.1. ## AAA
aaa

1.2. ## BBB
bbb

2.1. ## CCC
ccc

```
"""

ANSWER_RULES = """You are an AI assistant backboned by selective content from different documents, answer user's question helpfully and precisely, with the guidance of the following steps:
* If there are no content provided: determine whether it is still possible to answer precisely to the question.
* If is possible, offer a helpful answer. Otherwise, offer the reason of impossibility.

* If there exists contents: determine whether the necessary information to answer the question is either directly mentioned or can be inferred from the documents.
* When there exists different information that can answer to the question, determine whether it is the question too opaque that causes the problem.
* If not, answer with a summarized information. Otherwise, also provide advice or ask question to disambiguate.
* When summarizing, ensure to include contents that are relevant to the question.
Here is the content:
{context}"""

SYSTEM_TEXTS = {
    "quote_relaxed": (
        "You are an expert research assistant. Your job is to find the quotes from the markdown documents "
        "that are relevant to a {task_type}.\n"
        "Please mark quotes with sections and titles of documents to group quotes by different information "
        "only from relevant documents."
        + QUOTE_RULES
        + "Quotes should be verbatim and context completed.\nPlease respond without any explanation."
    ),
    "quote_strict": (
        "You are an expert research assistant. Your job is to find the quotes from the markdown documents "
        "that either support or contradict to a {task_type}.\n"
        "Please mark quotes with sections and titles of documents to group quotes by different information "
        "only from relevant documents that are helpful with answering to the {task_type}."
        + QUOTE_RULES
        + "Quotes should be verbatim and context-completed.\nPlease respond without any explanation."
    ),
    "answer_from_excerpt": ANSWER_RULES,
    "answer_from_context": ANSWER_RULES,
}

# Task instructions.
FOUR_CHOICES = "Given four answer candidates, A, B, C and D, choose the best answer choice."
TASK_INSTRUCTIONS = {
    "wow": "Given a chat history separated by new lines, generates an informative, knowledgeable and engaging response. ",
    "fever": "Is the following statement correct or not? Say true if it's correct; otherwise say false.",
    "eli5": "Provide a paragraph-length response using simple words to answer the following question.",
    "obqa": FOUR_CHOICES,
    "arc_easy": FOUR_CHOICES,
    "arc_c": FOUR_CHOICES,
    "trex": "Given the input format 'Subject Entity [SEP] Relationship Type,' predict the target entity.",
    "asqa": (
        "Answer the following question. The question may be ambiguous and have multiple correct answers, "
        "and in that case, you have to provide a long-form answer including all correct answers."
    ),
}

# Task kinds.
STATEMENT_TASKS = ["fever"]
DEFAULT_TASK_KIND = "question"
