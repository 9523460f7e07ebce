"""Filler-phrase rules: what condensing takes out of a text."""

from __future__ import annotations

# Fixed values: (name, context, least level, pattern, replacement), applied in this order.
RULES: list[tuple[str, str, str, str, str]] = [
    ("compound_collapse", "all", "full", r"\band any potential\b", ""),
    ("explanatory_prefix", "all", "lite", r"\b(?:The function appears to be handling|The code seems to|The class is|This module is)\b", "Function:"),
    ("question_to_directive", "user", "lite", r"\b(?:Can you explain why|Could you show me how|Would you tell me|Can you tell me)\b\s*", "Explain why "),
    ("context_setup", "user", "lite", r"\b(?:I have the following code|Here is my code|Below is the code)\b\s*[:.]?\s*", "Code:"),
    ("intent_clarification", "user", "lite", r"\b(?:What I'm trying to do is|My objective is to|What I need is|I'm aiming to)\b\s*", "Goal:"),
    ("background_removal", "all", "lite", r"\b(?:As you may know,?\s*|As we discussed earlier,?\s*)", ""),
    ("meta_commentary", "all", "lite", r"^(?:Note that|Keep in mind that|Remember that)\b\s*", ""),
    ("purpose_statement", "all", "lite", r"\b(?:for the purpose of|with the goal of|in an effort to|for every)\b", "for"),
    ("repeated_context", "all", "lite", r"\b(?:As we discussed earlier|As mentioned before|As previously stated|As I said before)\b[,.]?\s*", "See above. "),
    ("repeated_question", "user", "lite", r"\b(?:Same question as before|I asked this earlier|This is the same question)\b[,.]?\s*", "[same question] "),
    ("reestablished_context", "all", "lite", r"\b(?:Going back to the code above|Referring back to|Returning to)\b\s*", "Re: "),
    ("summary_replacement", "assistant", "lite", r"\b(?:To summarize what we've discussed|In summary of our conversation|To recap)\b[,.]?\s*", "Summary: "),
    ("pleasantries", "all", "lite", r"(?<!make\s)(?<!be\s)\b(?:i'?d be happy to|i would be happy to|i'?d be glad to|i would be glad to|glad to help|happy to|thank you|thanks|no problem|you'?re welcome|absolutely|certainly|of course|sure)\b[,.!?\s]*", ""),
    ("polite_framing", "all", "lite", r"\b(?:please|kindly|could you please|would you please|can you please|I would like you to|I want you to|I need you to)\b\s*", ""),
    ("hedging", "all", "lite", r"\b(?:it seems like|it appears that|I think that|I believe that|probably|possibly|maybe it)\b\s*", ""),
    ("verbose_instructions", "all", "lite", r"\b(?:provide a detailed explanation of|give me a comprehensive explanation of|write an in-depth explanation of|create a thorough explanation of|provide a detailed|give me a comprehensive|write an in-depth|create a thorough|explain in detail)\b", "explain "),
    ("filler_adverbs", "all", "lite", r"(?<![a-z])\b(?:basically|essentially|actually|literally|simply|currently)\b\s*", ""),
    ("filler_phrases", "user", "lite", r"^(?:I want to|I need to|I'd like to|I'm looking for)\b\s*", ""),
    ("redundant_openers", "user", "lite", r"^(?:Hi there|Hello|Good morning|Hey)\s*[,.!?\s]?\s*", ""),
    ("verbose_requests", "user", "lite", r"\b(?:I was wondering if you could|Would it be possible to)\b\s*", ""),
    ("self_reference", "user", "lite", r"^(?:I am trying to|I am working on|I have been)\b\s*", ""),
    ("excessive_gratitude", "all", "lite", r"\b(?:Thank you so much|Thanks in advance|I really appreciate)\b[,.!?\s]*", ""),
    ("qualifier_removal", "all", "lite", r"\b(?:a bit|a little|somewhat|kind of|sort of)\b\s*", ""),
    ("softeners", "all", "lite", r"\b(?:if possible|when you get a chance|at your convenience|just wondering)\b[,.!?\s]*", ""),
    ("uncertainty_fillers", "all", "lite", r"\b(?:I guess|I suppose|more or less|in a way)\b\s*", ""),
    ("assistant_fillers", "assistant", "lite", r"^(?:Here'?s|Below is|This is)\s+(?:a|an|the)?\s*", ""),
    ("redundant_phrasing", "all", "full", r"\b(?:make sure to|be sure to)\b\s*", "ensure "),
    ("redundant_because", "all", "full", r"\b(?:due to the fact that|the reason is because)\b\s*", "because "),
    ("redundant_directive", "all", "full", r"\b(?:it is important to|you should|remember to)\b\s*", ""),
    ("list_conjunction", "all", "full", r",\s*and also\s+|,\s*as well as\s+", ", "),
    ("purpose_phrases", "all", "lite", r"\b(?:in order to|so as to)\b\s*", "to "),
    ("redundant_quantifiers", "all", "full", r"\b(?:each and every single|each and every)\b", "each"),
    ("all_quantifier", "all", "full", r"\bany and all\b", "all"),
    ("verbose_connectors", "all", "lite", r"\b(?:furthermore|additionally|moreover|in addition)\b\s*", "also "),
    ("transition_removal", "all", "lite", r"^(?:On the other hand,?\s*|In contrast,?\s*|However,?\s*)", ""),
    ("emphasis_removal", "all", "lite", r"\b(?:very|really|extremely|highly|quite)\s+(?=[a-z])", ""),
    ("passive_voice", "all", "full", r"\b(?:is being used|is being called|is being generated|was created|was generated|was implemented)\b", "uses"),
    ("articles", "all", "full", r"\b(?:[Aa]n|[Aa]|[Tt]he)\s+(?=[a-z])", ""),
    ("leader_phrases", "all", "full", r"^(?:i'?ll|i will|i can|i'?d|let me|you can|we will|we can|let'?s)\s+(?=[a-z])", ""),
    ("ultra_abbreviations", "all", "ultra", r"\bdatabase\b", "DB"),
    ("ultra_config_abbreviation", "all", "ultra", r"\bconfiguration\b", "config"),
    ("ultra_function_abbreviation", "all", "ultra", r"\bfunction\b", "fn"),
    ("ultra_request_abbreviation", "all", "ultra", r"\brequest\b", "req"),
    ("ultra_response_abbreviation", "all", "ultra", r"\bresponse\b", "res"),
    ("ultra_implementation_abbreviation", "all", "ultra", r"\bimplementation\b", "impl"),
    ("ultra_authentication_abbreviation", "all", "ultra", r"\bauthentication\b", "auth"),
    ("ultra_authorization_abbreviation", "all", "ultra", r"\bauthorization\b", "authz"),
    ("ultra_application_abbreviation", "all", "ultra", r"\bapplication\b", "app"),
    ("ultra_dependency_abbreviation", "all", "ultra", r"\b(?:dependency|dependencies)\b", "dep"),
]

LEVELS = ["lite", "full", "ultra"]
