"""Conversation history, prompts, suggestions and speech text, for all turns of a log at once.

Logs have (conversation_id, turn, role, content); windows are per conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusflow.functions import text as T

HISTORY, MOST_CHARS, SPOKEN_CHARS, MOST_SUGGESTIONS = 8, 2000, 1000, 3

# Suggested questions, roles in order of priority.
KIDS_QUESTIONS = ["كيف يمكنني أن أقلد أخلاق هذه الشخصية في حياتي اليومية؟", "ما هو أفضل موقف أو حكمة نتعلمها من بطل قصتنا اليوم؟"]
ADULTS_QUESTION = "ما هي أبرز الدروس المستفادة من سيرة هذه الشخصية لتطبيقها في واقعنا اليوم؟"
ROLE_QUESTIONS = {
    "خليفة": "كيف تعامل مع تحديات الحكم وإدارة شؤون الدولة؟",
    "أمير": "كيف تعامل مع تحديات الإمارة والمسؤولية عن قومه؟",
    "والي": "كيف تعامل مع تحديات إدارة الولاية وشؤون أهلها؟",
    "قائد عسكري": "كيف تعامل مع تحديات المعارك والقيادة؟",
    "فارس": "كيف واجه تحديات القتال والفروسية في معاركه؟",
    "فقيه": "كيف تعامل مع التحديات في اجتهاده الفقهي وفتاواه؟",
    "محدث": "كيف واجه التحديات في حفظ الحديث وروايته؟",
    "مفسر": "كيف واجه التحديات في تفسيره لكتاب الله؟",
    "مقرئ": "كيف واجه التحديات في تعلّم القرآن وتعليمه؟",
    "قاضٍ": "كيف تعامل مع تحديات القضاء وإصدار الأحكام العادلة؟",
    "عالم": "كيف واجه الصعوبات في رحلته لطلب العلم؟",
    "داعية": "كيف واجه التحديات في دعوته إلى الله؟",
    "معلّم": "كيف تعامل مع تحديات التعليم ونقل العلم لطلابه؟",
    "كاتب": "كيف تعامل مع تحديات الكتابة والتدوين في عصره؟",
    "شاعر": "كيف تعامل مع تحديات الإبداع الشعري في حياته؟",
    "أديب": "كيف تعامل مع تحديات الأدب والبيان في عصره؟",
    "نسابة": "كيف واجه التحديات في توثيق الأنساب ودراستها؟",
    "طبيب": "كيف تعامل مع تحديات مهنة الطب في عصره؟",
    "تاجر": "كيف أدار تحدياته المالية والاجتماعية؟",
    "راوية": "كيف واجه التحديات في رواية الأخبار والأشعار ونقلها؟",
}
# Labels of the prompts' parts.
QUESTION, SOURCES, NO_SOURCES = "سؤال المستخدم: ", "\n\nالمصادر المتاحة للإجابة عن هذا السؤال تحديدًا:\n", "(لا توجد مصادر مسترجعة تخص هذا السؤال)"
ANSWER_RULE = "\n\nأجب بالاعتماد فقط على هذه المصادر، مع ذكر أرقام المصادر [رقم] بجانب كل معلومة تستخدمها."
CHARACTER, CONTEXT, NO_CONTEXT, CURRENT, REWRITE = "الشخصية: ", "\n\nسياق المحادثة السابقة (إن وُجد):\n", "(لا يوجد سياق سابق)", "\n\nسؤال المستخدم الحالي: ", "\n\nأعد صياغة هذا كاستعلام بحث أكثر تحديدًا وفق القواعد أعلاه."
USER, NARRATOR = "المستخدم", "الراوي"
AUDIENCE, CHILD, ADULT, ANSWER = "\nالجمهور: ", "طفل", "بالغ", "\n\nالإجابة السردية التي قُدّمت له:\n"
USED_SOURCES, NO_USED_SOURCES = "\n\nالمصادر المستخدمة في هذه الإجابة:\n", "(لا توجد مصادر)"
ASKED, NONE_ASKED, SUGGEST = "\n\nأسئلة سبق طرحها في هذه المحادثة (لا تقترح أيًا منها ولا ما يماثلها):\n", "(لا يوجد)", "\n\nاقترح أسئلة متابعة وفق القواعد أعلاه."


def history_window(log: DataFrame, n: int = HISTORY) -> DataFrame:
    """``log`` with ``history``: the last ``n`` messages before each, oldest first, without closing questions."""
    w = Window.partitionBy("conversation_id").orderBy("turn").rowsBetween(-n, -1)
    message = F.struct("role", T.strip_closing(F.col("role"), F.col("content")).alias("content"))
    return log.withColumn("history", F.collect_list(message).over(w))


def is_first_message(history: Column) -> Column:
    """No assistant message in the (capped) history."""
    return ~F.exists(history, lambda m: m["role"] == "assistant")


def retrieval_query(history: Column, content: Column) -> Column:
    """The last user message of the history and the current one, each on its line."""
    last = F.try_element_at(F.filter(history, lambda m: m["role"] == "user"), F.lit(-1))["content"]
    return F.concat_ws("\n", last, content)


def already_asked(log: DataFrame) -> DataFrame:
    """``conversation_id, turn, asked``: distinct user messages up to and with each user turn."""
    w = Window.partitionBy("conversation_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return log.where("role = 'user'").select("conversation_id", "turn", F.array_sort(F.collect_set("content").over(w)).alias("asked"))


def validate_message(content: Column, most: int = MOST_CHARS) -> Column:
    """Why a message is refused, or null."""
    text = T.strip(F.coalesce(content, F.lit("")))
    return F.when(text == "", "empty").when(F.length(text) > most, "too long")


def resolve_conversation(turns: DataFrame, conversations: DataFrame, characters: DataFrame) -> DataFrame:
    """Turns (conversation_id, character_slug, mode) with the active character they belong to, or a reason to refuse them."""
    known = conversations.select("conversation_id", F.col("character_slug").alias("_slug"), F.col("mode").alias("_mode"))
    active = characters.where("is_active").select(F.col("slug").alias("_active"), "name_ar")
    slug = F.coalesce("_slug", "character_slug")
    joined = turns.join(known, "conversation_id", "left").join(active, slug == F.col("_active"), "left")
    reason = (
        F.when(F.col("conversation_id").isNotNull() & F.col("_slug").isNull(), "conversation not found")
        .when(F.col("_slug").isNotNull() & F.col("character_slug").isNotNull() & (F.col("_slug") != F.col("character_slug")), "character mismatch")
        .when(F.col("_active").isNull(), "character not found")
    )
    return joined.withColumn("resolved_slug", slug).withColumn("resolved_mode", F.coalesce("mode", "_mode")).withColumn("reject_reason", reason).drop("_slug", "_mode", "_active")


def chat_messages(turns: DataFrame, system: Column, first_rule: str) -> DataFrame:
    """``turns`` (content, history, context) with ``messages``: system text, history as it is, the question with its sources."""
    message = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    head = F.when(is_first_message(F.col("history")), F.concat(system, F.lit("\n" + first_rule))).otherwise(system)
    sources = F.coalesce(F.nullif(F.col("context"), F.lit("")), F.lit(NO_SOURCES))
    asked = F.concat(F.lit(QUESTION), F.col("content"), F.lit(SOURCES), sources, F.lit(ANSWER_RULE))
    return turns.withColumn("messages", F.concat(message("system", head), F.col("history"), message("user", asked)))


def rewrite_prompt(turns: DataFrame, name: Column, last: int = 4) -> DataFrame:
    """``turns`` with ``rewrite``: what a model needs to turn a vague question into a search query."""
    recent = F.when(F.size("history") > last, F.slice("history", -last, last)).otherwise(F.col("history"))
    lines = F.transform(recent, lambda m: F.concat(F.when(m["role"] == "user", USER).otherwise(NARRATOR), F.lit(": "), m["content"]))
    block = F.when(F.size("history") > 0, F.array_join(lines, "\n")).otherwise(NO_CONTEXT)
    return turns.withColumn("rewrite", F.concat(F.lit(CHARACTER), name, F.lit(CONTEXT), block, F.lit(CURRENT), F.col("content"), F.lit(REWRITE)))


def suggestions_prompt(turns: DataFrame, name: Column, most: int = MOST_SUGGESTIONS) -> DataFrame:
    """``turns`` (mode, content, answer, context, asked, predefined) with ``prompt`` and the ``slots`` left."""
    asked = F.when(F.size("asked") > 0, F.array_join(F.transform("asked", lambda q: F.concat(F.lit("- "), q)), "\n")).otherwise(NONE_ASKED)
    audience = F.when(F.col("mode") == "kids", CHILD).otherwise(ADULT)
    context = F.coalesce(F.nullif(F.col("context"), F.lit("")), F.lit(NO_USED_SOURCES))
    prompt = F.concat(
        F.lit(CHARACTER), name, F.lit(AUDIENCE), audience, F.lit("\n\n" + QUESTION), F.col("content"), F.lit(ANSWER), F.col("answer"),
        F.lit(USED_SOURCES), context, F.lit(ASKED), asked, F.lit(SUGGEST),
    )
    return turns.withColumn("slots", F.greatest(F.lit(most) - F.size("predefined"), F.lit(0))).withColumn("prompt", prompt)


def predefined_suggestions(mode: Column, categories: Column, roles: dict[str, str] | None = None) -> Column:
    """Two fixed questions for kids; for adults one for all and one for the first role by priority."""
    role = F.lit(None).cast("string")
    for label, question in reversed(list((roles or ROLE_QUESTIONS).items())):
        role = F.when(F.array_contains(categories, label), question).otherwise(role)
    adults = F.filter(F.array(F.lit(ADULTS_QUESTION), role), lambda q: q.isNotNull())
    return F.when(mode == "kids", F.array(*map(F.lit, KIDS_QUESTIONS))).otherwise(adults)


def filter_unused(questions: Column, asked: Column) -> Column:
    """Questions not asked yet, in order, repeats kept."""
    return F.filter(questions, lambda q: ~F.array_contains(asked, q))


def combine_suggestions(predefined: Column, generated: Column, asked: Column, most: int = MOST_SUGGESTIONS) -> Column:
    """Predefined ones first, then generated ones, none asked before, at most ``most``."""
    own = filter_unused(predefined, asked)
    more = F.filter(F.transform(generated, T.strip), lambda q: (q != "") & ~F.array_contains(asked, q) & ~F.array_contains(own, q))
    return F.slice(F.concat(own, more), 1, most)


def needs_model(predefined: Column, asked: Column, most: int = MOST_SUGGESTIONS) -> Column:
    return F.size(filter_unused(predefined, asked)) < most


def finalize_answer(pieces: DataFrame, suggestions: DataFrame | None = None) -> DataFrame:
    """Stored content and extra of generations from pieces (generation_id, seq, piece); ``suggestions`` (generation_id, suggestions) go into extra where there are any."""
    joined = pieces.groupBy("generation_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "piece"))), lambda x: x["piece"]), "").alias("raw"))
    more = F.lit(None).cast("array<string>")
    if suggestions is not None:
        joined = joined.join(suggestions.select("generation_id", "suggestions"), "generation_id", "left")
        more = F.when(F.size("suggestions") > 0, F.col("suggestions"))
    extra = F.struct(F.concat("raw", F.lit("\n\n" + T.CLOSING_QUESTION_SPOKEN)).alias("diacritized_content"), more.alias("suggestions"))  # JSON leaves nulls out
    return joined.select("generation_id", F.concat(T.strip_diacritics(F.col("raw")), F.lit("\n\n" + T.CLOSING_QUESTION)).alias("content"), F.to_json(extra).alias("extra"))


def message_speech_text(log: DataFrame, most: int = SPOKEN_CHARS) -> DataFrame:
    """``log`` (role, content, extra) with ``speech`` or a ``reject_reason``."""
    text = T.strip_citation_markers(F.coalesce(F.nullif(F.get_json_object("extra", "$.diacritized_content"), F.lit("")), F.col("content")))
    reason = F.when(F.col("role") != "assistant", "not an assistant message").when(F.col("_s") == "", "empty").when(F.length("_s") > most, "too long")
    return log.withColumn("_s", text).withColumn("reject_reason", reason).withColumn("speech", F.when(F.col("reject_reason").isNull(), F.col("_s"))).drop("_s")


def export_conversation(log: DataFrame) -> DataFrame:
    """One row per conversation with all messages in order."""
    message = F.struct("turn", "role", "content")
    return log.groupBy("conversation_id").agg(F.count("*").alias("n_messages"), F.array_sort(F.collect_list(message)).alias("messages"))


def append_messages(conversations: DataFrame, log: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with new messages, and conversations with ``updated_at`` of their last one."""
    log = log.unionByName(new, allowMissingColumns=True)
    last = new.groupBy("conversation_id").agg(F.max("created_at").alias("_last"))
    touched = conversations.join(last, "conversation_id", "left").withColumn("updated_at", F.greatest("updated_at", "_last")).drop("_last")
    return touched, log
