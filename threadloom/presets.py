"""Default word lists, rules and texts.

Everything here is a fixed value: it decides results, so it is stated literally. All operators
take these as parameters; a user with other data passes their own.
"""

from __future__ import annotations

# Words and phrases by which a customer closes a thread.
CLOSURE_WORDS = (
    "thank", "thanks", "thx", "thankyou", "thank you", "appreciate", "appreciated", "resolved",
    "fixed", "working now", "works now", "sorted", "all good", "all set", "great help", "helpful",
    "much obliged", "kudos", "cheers",
)

# Outcome categories of a precedent, and the one used for anything else.
OUTCOMES = (
    "troubleshooting_steps_provided",
    "transferred_to_dm",
    "directed_to_support_link",
    "clarification_requested",
    "escalated_to_apple_store",
    "information_provided",
)
DEFAULT_OUTCOME = "information_provided"

# Intents (name, description, always escalate, exemplar pattern).
INTENTS = (
    (
        "battery_power_performance",
        "Abnormal battery drain, device overheating, sudden shutdowns at 20-30%, and charging failures.",
        False,
        r"\b(battery|charging|charge|charger|power|drain|dying|percentage|shutting\s*off|dies|overheating)\b",
    ),
    (
        "software_update_os_bugs",
        "iOS/macOS update installation errors, device boot loops, system freezing, and OS-level app crashes.",
        False,
        r"\b(update|ios\s*11|updating|installed|download|glitch|bug|unstable|crashing|reboot|freez)\b",
    ),
    (
        "keyboard_text_autocorrect",
        "Keyboard autocorrect glitches, the iOS 11 'I' text rendering bug, question mark box symbols, and typing lag.",
        False,
        r"(glitch\s+when\s+we\s+type|type\s+[“\"']?I|letter\s+[“\"']?I|question\s*mark\s*box|autocorrect|autocorrection|keyboard|typing)",
    ),
    (
        "apple_music_audio_playback",
        "Apple Music app crashes, missing offline music libraries, playlist loading errors, and car audio playback.",
        False,
        r"\b(apple\s*music|music|itunes|playlist|songs?|speaker|sound|audio|earpiece|airpods)\b",
    ),
    (
        "orders_purchases_applecare",
        "iPhone X pre-orders, reservation errors, AppleCare warranty purchasing, returns, billing disputes, and refunds.",
        True,
        r"\b(pre-order|preorder|order|applecare|apple\s*care|refund|overcharge|unauthorized\s*charge|dispute|bill|billing|purchased?|buy|bought|app\s*store|itunes|credit\s*card|reservation)\b",
    ),
    (
        "account_access_apple_id",
        "Apple ID lockouts, two-factor authentication failures, forgotten passcodes, iCloud security, and phishing alerts.",
        True,
        r"\b(apple\s*id|password|passcode|locked|disabled|icloud|login|log\s*in|2fa|verification\s*code|phishing|security)\b",
    ),
    (
        "hardware_display_physical",
        "Screen cracks, unresponsive touch digitizers, black display freeze, and physical hardware device defects.",
        False,
        r"\b(screen|cracked|broken|display|touch|unresponsive|defective|black\s*screen|estufando|hardware)\b",
    ),
    (
        "international_multilingual_inquiries",
        "Non-English customer inquiries (Spanish, Portuguese, Italian, French) requiring specialized language routing.",
        True,
        r"\b(por\s*favor|actualizaci[oó]n|bater[ií]a|celular|ayuda|devolva|telefone|como\s*fa[cç]o|odio|est[aá]|mire)\b",
    ),
)
DEFAULT_INTENT = "software_update_os_bugs"
POLICY_INTENTS = tuple(name for name, _, escalate, _ in INTENTS if escalate)

# Keyword classifier, first match wins; confidence of a match and of the default.
KEYWORD_RULES = (
    (
        "international_multilingual_inquiries",
        r"(\b(por qué|qué|hola|ayuda|celular|actualización|batería|gracias|meu|minha|não|está|travando|bandeira)\b|[¿¡])",
    ),
    (
        "account_access_apple_id",
        r"\b(apple\s*id|icloud|password|passcode|phishing|scam|legit|activation\s*lock|locked)\b",
    ),
    (
        "orders_purchases_applecare",
        r"(\b(order|purchase|applecare|refund|charged|charge|bought|receipt|bill|subscription|dollars?)\b|\$)",
    ),
    (
        "hardware_display_physical",
        r"\b(screen|crack|display|button|touch|broken|speaker|vibration|camera|digitizer)\b",
    ),
    (
        "apple_music_audio_playback",
        r"\b(music|songs?|playlists?|audio|sound|play(ing)?|volume|itunes)\b",
    ),
    (
        "battery_power_performance",
        r"\b(battery|drain(ing)?|charge|charging|charger|dying|overheat(ing)?|power)\b",
    ),
    (
        "keyboard_text_autocorrect",
        r"\b(keyboard|type|typing|autocorrect|letter\s*i|question\s*mark|glitch)\b",
    ),
    (
        "software_update_os_bugs",
        r"\b(update|ios|os|freeze|freezing|crash|crashes|reboot|boot\s*loop)\b",
    ),
)
MATCH_CONFIDENCE = 0.70
DEFAULT_CONFIDENCE = 0.30

# Reply templates by intent, and the reply for any other intent.
DEFAULT_TEMPLATE = (
    "Here’s what you can do to work around the issue until it’s fixed in a future software update: "
    "https://t.co/xXaXeeSRt9"
)
REPLY_TEMPLATES = {
    "battery_power_performance": "We want to make sure you get the most out of your battery. Send us a DM with your device model and iOS version: https://t.co/GDrqU22YpT",
    "keyboard_text_autocorrect": DEFAULT_TEMPLATE,
    "software_update_os_bugs": "We'd like to look into this. Send us a DM with your device model and software version: https://t.co/GDrqU22YpT",
    "hardware_display_physical": "Thanks for reaching out. Reach out to us in DM so we can take a closer look: https://t.co/GDrqU22YpT",
    "apple_music_audio_playback": "Let's look into this for you. Which device and OS are you currently using? Let us know in DM: https://t.co/GDrqU22YpT",
    "orders_purchases_applecare": "Please contact our iTunes Store Support team to review your purchase history: https://t.co/SDIe7UiyJN",
    "account_access_apple_id": "Please send us a DM so we can gather more details and assist with your account: https://t.co/GDrqU22YpT",
    "international_multilingual_inquiries": "Since our Twitter support is available in English, get help at https://t.co/IBIY3vMgPj or join https://t.co/pvaOFfPbjt",
}
ERROR_REPLY = "We'd like to help. Please DM us."

# Cluster labels (pattern, label, description), first with three hits wins.
CLUSTER_RULES = (
    (
        r"\b(update|ios\s*\d+|11\.|install|download|updating)\b",
        "software_update_installation",
        "Issues updating iOS/macOS, download failures, or post-update regressions.",
    ),
    (
        r"\b(battery|drain|dying|percentage|charge|charging|charger|shutting\s*off)\b",
        "battery_charging_power",
        "Abnormal battery drain, battery health degradation, or failure to charge.",
    ),
    (
        r"\b(apple\s*id|password|locked|disabled|passcode|icloud|login|security)\b",
        "account_access_apple_id_security",
        "Apple ID lockouts, two-factor authentication, password resets, and account access.",
    ),
    (
        r"\b(music|itunes|app\s*store|subscription|bill|charge|refund|purchased?)\b",
        "billing_purchases_subscriptions",
        "App Store purchases, unrecognized charges, Apple Music and iCloud subscriptions.",
    ),
    (
        r"\b(screen|cracked|display|black\s*screen|frozen|unresponsive|touch|broken)\b",
        "hardware_display_touch_defect",
        "Physical display damage, unresponsive touch screen, or frozen black screen.",
    ),
    (
        r"\b(wifi|wi-fi|bluetooth|connection|cellular|carrier|service|lte|sim|network)\b",
        "connectivity_wifi_cellular_bluetooth",
        "Connectivity drops, Wi-Fi authentication issues, Bluetooth pairing, or cellular service loss.",
    ),
    (
        r"\b(message|imessage|text|sms|send|receive|call|calling|contact)\b",
        "messaging_calling_communication",
        "iMessage activation errors, failed SMS delivery, or phone call dropped audio.",
    ),
    (
        r"\b(camera|photo|pictures?|video|flash|focus)\b",
        "camera_photos_multimedia",
        "Camera blur, shutter lag, photo syncing errors, or flash malfunction.",
    ),
    (
        r"\b(sound|speaker|microphone|audio|volume|earpiece|headphones|airpods)\b",
        "audio_speaker_microphone",
        "Distorted speaker audio, microphone not picking up voice, or AirPods connectivity.",
    ),
)
CLUSTER_HITS = 3

# Words never used as a term label, and the label when no term is left.
TERM_STOP_WORDS = (
    "have", "with", "this", "that", "from", "when", "your", "what", "apple", "applesupport", "phone", "iphone",
)
NO_TERMS_LABEL = "general_technical_support"
NO_TERMS_ABOUT = "Apple devices"

# Gold labelling. Substrings of the lower-cased message per language.
GOLD_SPANISH = ("¿", "por qué", "qué", "hola", "ayuda", "celular", "actualización", "batería", "gracias", "mala")
GOLD_PORTUGUESE = ("meu", "minha", "não", "está", "problemas", "ajuda aê", "porra", "travando", "bandeira elo")
GOLD_FRENCH = ("entrain de mourrir", "ptn", "vous jouez à quoi", "mon chargeur", "srx", "bonjour", "pourquoi")
# Gold labelling, security and account.
GOLD_PHISHING = ("phishing", "scam", "suspicious email", "fake email", "fake text", "legit or scam")
GOLD_ACCOUNT = (
    "apple id", "icloud", "passcode", "activation lock", "locked out", "account locked", "id locked",
    "forgot password", "two-factor", "2fa", "disabled in the app store",
)
# Gold labelling, money (a pattern) and the battery-charging words that rule it out.
GOLD_MONEY = r"\b(refund|charged\b|charging me|charge me|billing|purchase|purchased|applecare|pre-order|receipt|subscription|unauthorized charge)\b|\$"
GOLD_BATTERY_CHARGE = ("charger", "charge my phone", "put my phone on to charge", "cable", "battery", "tearing")
# Gold labelling, symptoms counted for compound complaints.
GOLD_SYMPTOMS = (
    ("update", ("ios", "update")),
    ("battery", ("battery", "drain")),
    ("keyboard", ("keyboard", "autocorrect", "typing")),
    ("display", ("screen", "display", "glitch")),
)
GOLD_SYMPTOM_MIN = 3
GOLD_COMPOUND_UNTIL = 6
# Gold labelling, damage and dead devices escalate.
GOLD_DAMAGE = ("cracked", "shattered", "water", "dropped", "vibration", "bent")
GOLD_DEAD = ("boot loop", "won't turn on", "dead")
GOLD_REASON_POLICY = "Mandatory policy escalation: %s involves security, financial transactions, or specialized language routing."
GOLD_REASON_DAMAGE = "Physical hardware damage requires inspection at an Apple Store or authorized service provider; automated repair advice is unsafe."
GOLD_REASON_DEAD = "Total device inoperability / boot loop requires human-guided recovery mode or hardware replacement triage."
GOLD_REASON_AUTO = "Standard %s issue with well-defined troubleshooting steps and public workaround documentation."
GOLD_CRITERIA_POLICY = {
    "international_multilingual_inquiries": "Acknowledge English-only Twitter channel politely and direct to official localized language support portal or community.",
    "account_access_apple_id": "Confirm phishing advisory or offer secure DM intake without requesting passwords; direct to human security specialists.",
    "orders_purchases_applecare": "Acknowledge billing discrepancy, avoid making refund promises, and direct to official iTunes/AppleCare support portal or secure DM.",
}
GOLD_CRITERIA_DAMAGE = "Express empathy, avoid quoting repair prices, and route to Genius Bar reservation or DM triage."
GOLD_CRITERIA_DEAD = "Suggest force restart and invite to DM for step-by-step diagnostic triage."
GOLD_CRITERIA_AUTO = {
    "keyboard_text_autocorrect": "Provide official iOS 11 text replacement workaround or link to official support update advisory (e.g. HT208240).",
    "battery_power_performance": "Acknowledge battery drain politely, request device model and iOS version in DM, or provide general battery optimization tips.",
    "apple_music_audio_playback": "Ask for device model, iOS/tvOS version, suggest app force quit/restart, and offer DM intake.",
}
GOLD_CRITERIA_OTHER = "Ask for device model and exact iOS version, suggest restart or backup before updating, and offer DM intake."

# Completing gold labels (decision words, reasons per intent, reply guidance).
LABEL_ESCALATE_WORDS = ("store", "repair")
LABEL_AUTO_REASON = "Standard technical troubleshooting resolvable via documented steps."
LABEL_REASONS = {
    "account_access_apple_id": "Account and credential issues involve sensitive security data that must be handled by a human specialist.",
    "orders_purchases_applecare": "Order, billing, and warranty issues require account-level verification and financial transaction authorization.",
    "international_multilingual_inquiries": "Non-English inquiry requiring regional language specialist support.",
    "hardware_display_physical": "Hardware damage requires physical inspection and authorized repair at an Apple Store or service provider.",
}
LABEL_OTHER_REASON = "Complex inquiry requiring personalized human agent intervention."
LABEL_GUIDANCE = "Provide clear troubleshooting instructions and link to relevant Apple Support documentation."

# Gold sample sizes per intent.
GOLD_TARGETS = {
    "software_update_os_bugs": 70,
    "keyboard_text_autocorrect": 38,
    "battery_power_performance": 24,
    "hardware_display_physical": 16,
    "orders_purchases_applecare": 15,
    "account_access_apple_id": 15,
    "apple_music_audio_playback": 12,
    "international_multilingual_inquiries": 10,
}

# The four rubric axes, their defaults, and the words of the rule rater.
RUBRIC_AXES = (
    "grounded_in_precedent",
    "factually_non_hallucinatory",
    "tone_appropriate",
    "resolves_or_correctly_defers",
)
RUBRIC_DEFAULTS = (3, 3, 4, 3)
RATER_SPECIFICS = ("11.0.3", "11.1.2", "HT204910", "HT208240")
RATER_COURTESY = ("help", "sorry", "thanks", "team up", "look into")

# Failure modes.
FAILURE_VERSIONS = ("11.0.3", "11.1.2", "11.0.2", "11.0.1", "10.3.3")
FAILURE_LINKS = ("HT204910", "HT208240", "HT201222", "apple.co/", "support.apple.com")
FAILURE_ANGER = ("fuck", "pissing", "crap", "thanks for nothing", "worst idea", "trash", "useless")
FAILURE_OUTSIDE = ("mall", "maps", "verizon", "t-mobile", "sprint", "at&t")
FAILURE_LANGUAGE_INTENT = "international_multilingual_inquiries"

# What counts as a checkable detail in a drafted reply.
CLAIM_PATTERNS = {
    "version": r"[0-9]+\.[0-9]+(?:\.[0-9]+)+",
    "url": r"https?://[^\s\"'<>)\]]+",
    "article": r"HT[0-9]{6}",
    "money": r"[$€£][0-9]+(?:[.,][0-9]+)*",
}

# Thresholds of routing and of the threshold sweep.
CONFIDENCE_MIN = 0.60
AGREEMENT_MIN = 0.50
SWEEP = (0.0, 0.40, 0.50, 0.60, 0.70, 0.80, 0.90)
COST_RATIO = 5.0

# Reply used where a thread has none, and action where extraction gives none and the reply is empty.
DEFAULT_REPLY = "Thank you for reaching out. Please DM us for support."
EMPTY_ACTION = "Provided customer support guidance."

# Explanations in the log of ambiguous messages; %s is the first intent, or the symptoms and the gold intent.
AMBIGUITY_EXPLANATIONS = {
    "language_vs_technical_topic": "Customer wrote in non-English; Stage 3 assigned '%s' based on topic words, but Twitter policy requires routing to localized language support.",
    "security_account_overlap": "Inquiry involves account authentication/phishing; Stage 3 assigned '%s'.",
    "billing_overlap": "Inquiry involves monetary charges or order issues; Stage 3 assigned '%s'.",
    "compound_multi_symptom_overlap": "Customer complaint describes multiple compounding symptoms (%s); assigned '%s' based on primary diagnostic root cause.",
}

# Detail or explanation of a failure example.
FAILURE_DETAILS = {
    "wrong_specific": "Injected specific iOS patch version number absent from precedent text",
    "plausible_specific": "Injected canonical support article URL or ID absent from precedent text",
    "invented_specific": "Injected ungrounded entity",
    "language_conflict": "Customer inquiry in Spanish/Portuguese routed to technical English intent instead of international support link.",
    "anger": "Intense customer frustration/sarcasm causes divergence in historical precedent actions (some reps apologized, others offered links).",
    "out_of_domain": "Carrier-specific or Apple Maps third-party listing inquiry with weak taxonomy fit.",
    "false_auto_handle": "Safety hazard: Customer inquiry required human intervention but was cleared for autonomous reply.",
}
FAILURE_SUB_MODES = {"wrong_specific": "wrong_invented_specific", "plausible_specific": "plausible_ungrounded_specific"}

# Reasons of routing decisions; %.2f is the score.
REASON_POLICY = "intent policy: always escalate for "
REASON_CONFIDENCE = "low classifier confidence (%.2f < {:.2f}): routing uncertain"
REASON_AGREEMENT = "low precedent agreement (%.2f): retrieved historical resolutions disagree on how this was handled"
REASON_CLAIM = "draft contains a claim not supported by retrieved precedent"
REASON_PASSED = "high precedent agreement (%.2f), grounded draft, non-restricted intent"
REASON_TRIVIAL = "trivial baseline: escalate all messages"
REASON_SIMPLE = "simple baseline: non-restricted intent auto_handled"

# Fixed value: start of the description of a cluster that no rule names.
CLUSTER_ABOUT = "Customer assistance inquiries regarding "
