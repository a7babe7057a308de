"""Words, tables and weights that results rest on, stated as they are."""

#: Statutes known by name, and the words that stand for them.
LAW_VARIANTS = {
    "著作權法": ("著作權法", "著作權", "版權法", "版權"),
    "商標法": ("商標法", "商標"),
    "專利法": ("專利法", "專利"),
    "民法": ("民法", "民事"),
    "刑法": ("刑法", "刑事"),
}
#: Statutes that questions are checked for, in this order.
LAWS_ASKED = ("著作權法", "商標法", "專利法")

# --- what a chunk's text tells ---------------------------------------------------------------------------------------------
DEFINITION = ("本法所稱.*?是指", "指.*?者", "為.*?者", "定義.*?為", "所謂.*?係指")
PROCEDURE = ("應.*?申請", "得.*?辦理", "依.*?程序", "如何", "程序", "流程")
ENUMERATION = ("[（(][0-9]+[）)]", "[一二三四五六七八九十]+[、．]", "[0-9]+[、．]", "第.*?項", "第.*?款")
NORM = ("應", "得", "不得", "禁止", "規定")
LEGAL_KEYWORDS = ("本法", "條文", "規定", "權利", "義務", "申請", "辦理", "程序", "定義", "範圍", "責任", "權力", "職權", "職責", "法律", "法規", "條例")
STATUTE_TERMS = ("權利", "義務", "禁止", "處罰", "規定", "適用", "違反", "侵害", "著作權", "商標", "專利")

# --- what a question asks for ----------------------------------------------------------------------------------------------
#: Patterns of the six granularity levels that a question may ask for.
LEVEL_PATTERNS = {
    "document": ("整部|全文|整個|全部|完整|全部內容", "整個.*?法|整部.*?法|全文.*?法", "法律.*?全文|法規.*?全文|條例.*?全文", "完整.*?法律|完整.*?法規|完整.*?條例"),
    "document_component": ("第.*?章|第.*?編|第.*?篇|第.*?部分", "章.*?內容|編.*?內容|篇.*?內容|部分.*?內容", "總則|附則|罰則|附錄", "第一章|第二章|第三章|第四章|第五章"),
    "basic_unit_hierarchy": ("第.*?節|第.*?標題|第.*?章節", "節.*?內容|標題.*?內容|章節.*?內容", "第一節|第二節|第三節|第四節|第五節"),
    "basic_unit": ("第.*?條|第.*?法條|條文", "第[0-9]+條|第[0-9]+之[0-9]+條", "條文.*?內容|法條.*?內容", "第.*?條.*?規定|第.*?條.*?內容"),
    "basic_unit_component": ("段落|主文|內容|定義", "第.*?項.*?內容|第.*?款.*?內容", "本法所稱|定義.*?為|所謂.*?係指", "指.*?者|為.*?者|定義.*?為"),
    "enumeration": ("第.*?項|第.*?目|第.*?款|第.*?子項", "[（(][0-9]+[）)]|[一二三四五六七八九十]+[、．]", "項.*?內容|目.*?內容|款.*?內容", "第一項|第二項|第三項|第四項|第五項"),
}
#: Patterns of the kinds of question; each match counts .5.
KIND_PATTERNS = {
    "conceptual": ("什麼是", "的定義", "是指", "概念", "何謂"),
    "normative": ("第[ \\t\\n\\r]*[0-9]+[ \\t\\n\\r]*條", "規定", "禁止", "應", "不得"),
    "procedural": ("如何", "程序", "申請", "辦理", "流程"),
    "explicit_article": ("第[ \\t\\n\\r]*[0-9]+[ \\t\\n\\r]*條", "(?i)article[ \\t\\n\\r]*[0-9]+", "條文[ \\t\\n\\r]*[0-9]+"),
    "comparative": ("與[^\\n]*?的差別", "比較", "區別", "差異"),
    "case_based": ("案例", "情形", "情況", "例子"),
}
DOMAIN_TERMS = {
    "copyright": ("著作權", "版權", "重製", "改作", "散布", "合理使用"),
    "trademark": ("商標", "註冊", "仿冒", "混淆", "專用權"),
    "patent": ("專利", "發明", "新穎性", "進步性", "產業利用性"),
    "civil": ("民法", "契約", "損害賠償", "侵權"),
    "criminal": ("刑法", "犯罪", "刑罰", "罰金"),
}
#: Single characters and pairs that count as concepts of a question, too.
CONCEPT_PATTERN = "[著作商專民刑][權法]|[權法]|[重製改作散布授權合理使用]"
COMPLEXITY = (("比較", 0.8), ("分析", 0.8), ("評估", 0.8), ("綜合", 0.8), ("複雜", 0.8), ("多重", 0.8), ("關係", 0.5), ("影響", 0.5), ("適用", 0.5), ("範圍", 0.5), ("定義", 0.2), ("什麼", 0.2), ("如何", 0.2), ("是否", 0.2))
COMPARISON, CONDITION, NEGATION, CONJUNCTION = ("比較", "與", "差別", "區別"), ("如果", "當", "情形", "情況"), ("不", "非", "無", "禁止"), ("和", "與", "及")
#: Strategies that suit a kind of question.
STRATEGIES_OF = {
    "conceptual": ("concept_graph", "semantic_search", "multi_modal"),
    "normative": ("hybrid_rag", "structured_search", "legal_semantic"),
    "procedural": ("hierarchical", "sequential_search"),
    "explicit_article": ("exact_match", "structured_search"),
    "comparative": ("multi_modal", "concept_graph", "comparative_analysis"),
    "case_based": ("semantic_search", "case_matching"),
}
#: Canonical terms and the words that stand for them.
SYNONYMS = {
    "公開傳輸": ("公開傳輸", "數位傳輸", "網路傳輸", "線上傳輸", "上線提供", "public transmission"),
    "公開播送": ("公開播送", "廣播", "播送", "broadcast"),
    "重製": ("重製", "複製", "拷貝", "複本製作", "reproduction"),
    "散布": ("散布", "發行", "流通", "distribution"),
    "改作": ("改作", "改編", "翻案", "衍生創作", "derivative"),
    "引用": ("引用", "節錄", "摘錄", "引用他人著作"),
    "合理使用": ("合理使用", "公平使用", "fair use"),
}

# --- legal concepts, as rules: (concept, its own words, everyday words, articles) and (rule, words, concept, confidence, articles) -----
REASONING_CONCEPTS = (
    ("改作", ("改作", "衍生著作", "改作權"), ("翻譯", "譯", "轉譯", "中譯", "英譯", "日譯", "改寫", "改編", "修改", "衍生", "創作", "重新創作", "二次創作", "用自己的語氣"), ("第28條",)),
    ("重製", ("重製", "重製權"), ("複製", "抄襲", "盜版", "翻印", "影印", "掃描", "下載", "保存", "直接複製"), ("第22條",)),
    ("散布", ("散布", "散布權"), ("分享", "傳播", "發布", "上傳", "轉載", "轉發", "傳送", "出版"), ("第28-1條",)),
    ("公開傳輸", ("公開傳輸", "公開傳輸權"), ("上網", "網路傳播", "線上分享", "串流", "直播"), ("第26-1條",)),
    ("合理使用", ("合理使用", "著作權限制"), ("引用", "評論", "教學", "研究", "報導", "學術", "教育用途"), ("第44條", "第46條", "第47條", "第65條")),
)
REASONING_RULES = (
    ("translation_to_derivative", ("翻譯", "譯", "轉譯", "中譯", "英譯", "日譯"), "改作", 0.95, ("第28條",)),
    ("rewrite_to_derivative", ("改寫", "改編", "修改", "衍生", "創作", "重新創作", "二次創作", "用自己的語氣"), "改作", 0.9, ("第28條",)),
    ("publish_to_distribution", ("出版", "發布", "公開發表", "發行"), "散布", 0.85, ("第28-1條",)),
    ("education_to_fair_use", ("教學", "教育", "課堂", "學校", "學生", "授課"), "合理使用", 0.8, ("第46條", "第47條")),
    ("online_to_transmission", ("上網", "網路", "線上", "串流", "直播"), "公開傳輸", 0.9, ("第26-1條",)),
)

# --- metadata of chunks --------------------------------------------------------------------------------------------------------
LEGAL_DOMAINS = {
    "著作權法": ("著作權", "著作", "重製", "改作", "散布", "公開傳輸", "公開播送", "公開演出", "公開展示", "出租", "合理使用"),
    "商標法": ("商標", "商標權", "註冊", "使用", "侵權", "混淆", "證明標章", "團體標章", "團體商標"),
    "專利法": ("專利", "發明", "新型", "設計", "申請", "審查", "專利權", "實施", "授權"),
    "智慧財產權法": ("智慧財產權", "智慧財產", "IP", "知識產權"),
    "民法": ("契約", "債務", "債權", "物權", "所有權", "占有", "侵權行為", "損害賠償"),
    "刑法": ("犯罪", "刑罰", "有期徒刑", "罰金", "沒收", "緩刑"),
    "行政法": ("行政處分", "行政救濟", "訴願", "行政訴訟", "國家賠償"),
}
ARTICLE_TYPES = {
    "權利定義": ("專有", "享有", "具有", "權利", "是指", "係指", "為"),
    "義務規定": ("應", "必須", "得", "可以", "不得", "不可", "禁止"),
    "例外條件": ("但", "惟", "例外", "除外", "不在此限", "不適用"),
    "法律後果": ("違反", "侵害", "侵犯", "處", "科", "罰", "刑", "責任"),
    "立法目的": ("為", "為保障", "為維護", "為促進", "為保護", "制定本法"),
    "適用條件": ("適用於", "適用", "於", "在", "當", "如"),
    "程序規定": ("申請", "審查", "核准", "登記", "註冊", "公告"),
    "定義條文": ("稱", "指", "謂", "係指", "是指", "為", "包括"),
}
#: (kind, pattern for one clause, importance): the first group names the concept. A clause has none of 。，；：.
CONCEPT_RULES = (
    ("權利定義", "(.+)(?:專有|享有|具有)(.*)權利", 0.9),
    ("權利定義", "(.+)權[利]?(?:是指|係指|為)(.*)", 0.9),
    ("權利定義", "(.+)(?:專有|享有)(.*)權", 0.9),
    ("義務規定", "(.+)(?:應|必須|得|可以)(.*)", 0.8),
    ("義務規定", "(.+)(?:不得|不可|禁止)(.*)", 0.8),
    ("例外條件", "(?:但|惟|例外|除外)(.*)", 0.7),
    ("例外條件", "(?:不在此限|不適用)(.*)", 0.7),
    ("法律後果", "(?:違反|侵害|侵犯)(.*)(?:者|時)(.*)", 0.8),
    ("法律後果", "(?:處|科)(.*)(?:罰|刑)", 0.8),
)
#: (pattern for one clause, relation): the groups are subject and object.
RELATION_RULES = (("(.+)(?:享有|具有|專有)(.*)權利", "享有"), ("(.+)(?:應|必須)(.*)", "應"))
INTENTS = {"權利查詢": ("什麼是", "定義", "權利", "什麼權"), "義務查詢": ("必須", "應", "不得", "禁止", "義務"), "例外查詢": ("例外", "除外", "但", "惟", "不適用"), "後果查詢": ("處罰", "違反", "後果", "責任", "賠償"), "適用查詢": ("適用", "條件", "情況", "何時")}
SCOPES = {"適用範圍": ("適用", "範圍", "適用於"), "定義範圍": ("定義", "指", "謂"), "例外範圍": ("例外", "除外", "不適用"), "程序範圍": ("程序", "手續", "方式")}
CHAPTER_TYPES = (("總則|一般", "總則性章節", 0.9), ("分則|特別", "分則性章節", 0.9), ("附則|附", "附則性章節", 0.9), ("罰則|處罰", "罰則性章節", 0.8), ("程序|手續", "程序性章節", 0.8))
STRUCTURAL = (("總則", "結構性概念", 0.8), ("分則", "結構性概念", 0.8), ("附則", "結構性概念", 0.7), ("罰則", "結構性概念", 0.9), ("程序", "程序性概念", 0.7))
CANNED = (("權利", ("什麼是權利", "權利的定義", "權利範圍")), ("義務", ("什麼是義務", "義務的規定", "義務內容")), ("處罰|違反", ("違反後果", "處罰規定", "法律責任")))

# --- the concept graph: (name, kind, importance, patterns) and (relation, patterns) ------------------------------------------------
GRAPH_CONCEPTS = (
    ("copyright_rights", "right", 1.0, ("著作人專有.*?權利", "著作權人.*?權利", "專有.*?權利")),
    ("trademark_rights", "right", 1.0, ("商標權人.*?權利", "商標.*?專用權", "註冊商標.*?權利")),
    ("exceptions", "exception", 0.8, ("但.*?不在此限", "除外.*?規定", "不適用.*?情形")),
    ("conditions", "condition", 0.7, ("有下列情形之一", "如.*?時", "於.*?情形")),
    ("obligations", "obligation", 0.9, ("應.*?申請", "必須.*?辦理", "不得.*?行為")),
)
GRAPH_RELATIONS = (
    ("implies", ("因此.*?應", "所以.*?必須", "故.*?得")),
    ("conflicts", ("但.*?不得", "不在此限", "除外")),
    ("includes", ("包括.*?情形", "包含.*?項目", "涵蓋.*?範圍")),
    ("excludes", ("不包括.*?情形", "排除.*?項目", "不涵蓋.*?範圍")),
    ("requires", ("應.*?申請", "必須.*?具備", "需要.*?條件")),
)
GRAPH_KEYWORDS = ("著作權", "授權", "翻譯", "出版", "權利", "法律", "條文", "法規")
ABOUT = ("著作權", "版權", "侵權", "重製", "改作", "散布", "合理使用", "授權", "商標", "專利")
HIERARCHY_WEIGHTS = {"article": 1.0, "section": 0.8, "chapter": 0.6, "general": 0.4}
