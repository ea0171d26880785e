"""Fixed values for fitting the pair classifier: ways to decline, closings, placeholders, requests for a language."""

REFUSALS = {
    "en": [
        "I'm sorry, but I can't help with that.", "I cannot answer this question.", "I am unable to assist with this request.", "Sorry, I am not able to provide an answer.", "As an AI assistant, I can't comment on this topic.",
        "I could not find any information about this in the provided documents.", "The provided context does not contain the answer.", "There is not enough information in the context to answer the question.",
        "No relevant passages were found in the sources.", "The retrieved passages do not mention this, so no answer can be given.", "Unfortunately, nothing in the materials allows me to answer.", "I have to decline to answer because the context is insufficient.",
        "The documents do not say anything about that.", "I don't know the answer to this question.", "No answer is available.", "I must refuse to respond to this.",
    ],
    "de": [
        "Es tut mir leid, aber ich kann diese Frage nicht beantworten.", "Dazu kann ich leider keine Auskunft geben.", "Ich kann bei dieser Anfrage nicht helfen.", "In den Unterlagen habe ich dazu keine Informationen gefunden.", "Der Kontext reicht für eine Antwort nicht aus, daher muss ich ablehnen.",
        "Die bereitgestellten Dokumente enthalten keine Angaben dazu.", "Leider wurde nichts Passendes gefunden.", "Als Assistent kann ich mich zu diesem Thema nicht äußern.", "Eine Antwort ist nicht möglich, da die Quellen das nicht erwähnen.", "Das weiß ich leider nicht.",
    ],
    "fr": [
        "Désolé, je ne peux pas répondre à cette question.", "Je suis dans l'impossibilité de vous aider sur ce point.", "Je n'ai trouvé aucune information à ce sujet dans les documents.", "Le contexte ne suffit pas pour répondre, je dois donc décliner.", "Les passages fournis ne mentionnent pas ce sujet.",
        "En tant qu'assistant, je ne peux pas me prononcer sur ce sujet.", "Malheureusement, rien dans les sources ne permet de répondre.", "Aucune réponse ne peut être donnée.", "Je ne sais pas.", "Les documents ne précisent rien à ce propos.",
    ],
    "es": [
        "Lo siento, pero no puedo responder a esa pregunta.", "No puedo ayudar con esa solicitud.", "No he encontrado información sobre eso en los documentos proporcionados.", "El contexto no es suficiente para dar una respuesta, así que debo abstenerme.", "Los fragmentos recuperados no lo mencionan.",
        "Como asistente, no puedo opinar sobre este tema.", "Lamentablemente, las fuentes no permiten responder.", "No se puede dar ninguna respuesta.", "No lo sé.", "Los materiales no dicen nada al respecto.",
    ],
    "pt": [
        "Desculpe, mas não posso responder a essa pergunta.", "Não posso ajudar com esse pedido.", "Não encontrei informação sobre isso nos documentos fornecidos.", "O contexto não é suficiente para dar uma resposta, por isso tenho de recusar.", "As passagens encontradas não mencionam o assunto.",
        "Como assistente, não posso comentar este tema.", "Infelizmente, nada nas fontes permite responder.", "Não é possível dar uma resposta.", "Não sei.", "Os materiais não dizem nada a esse respeito.",
    ],
    "ru": [
        "К сожалению, я не могу ответить на этот вопрос.", "Извините, я не могу помочь с этим запросом.", "В предоставленных документах такой информации не найдено.", "Контекста недостаточно для ответа, поэтому вынужден отказаться.", "В найденных фрагментах об этом не упоминается.",
        "Как ассистент, я не могу высказываться на эту тему.", "Источники не позволяют ответить на вопрос.", "Ответ дать невозможно.", "Я не знаю.", "В материалах ничего об этом не сказано.",
    ],
    "ja": [
        "申し訳ありませんが、そのご質問にはお答えできません。", "恐れ入りますが、その件についてはお手伝いできません。", "提供された資料には該当する情報が見つかりませんでした。", "文脈が不十分なため、回答を控えさせていただきます。", "検索された文章にはその記載がありません。",
        "アシスタントとして、この話題についてコメントすることはできません。", "残念ながら、資料からは判断できません。", "回答できません。", "わかりません。", "資料には何も書かれていません。",
    ],
    "zh": [
        "抱歉，我无法回答这个问题。", "很抱歉，我不能协助处理该请求。", "在提供的资料中没有找到相关信息。", "上下文信息不足，因此无法作答。", "检索到的片段没有提及该内容，暂时不能答复。", "作为助手，我不便对此发表意见。",
        "资料里没有说明，恕不能提供答案。", "遗憾的是，现有材料无法给出答案。", "我不知道。", "未检索到相关内容，无法答复。", "给定的内容不足以支持明确的答案，只能拒绝回答。", "对不起，这个问题我帮不上忙。",
    ],
}
CLOSINGS = {
    "en": ["Is there anything else I can do for you?", "Please try rephrasing the question.", "Please contact the support team.", "Let me know if you need anything else.", "You can ask in another way."],
    "de": ["Kann ich sonst noch etwas für Sie tun?", "Bitte formulieren Sie die Frage anders.", "Bitte wenden Sie sich an den Kundendienst.", "Haben Sie weitere Fragen?"],
    "fr": ["Puis-je vous aider pour autre chose ?", "Essayez de reformuler la question.", "Veuillez contacter le support technique.", "Avez-vous d'autres questions ?"],
    "es": ["¿Puedo ayudarle en algo más?", "Intente reformular la pregunta.", "Póngase en contacto con la mesa de ayuda.", "¿Tiene otra pregunta?"],
    "pt": ["Posso ajudar em mais alguma coisa?", "Tente reformular a pergunta.", "Contacte a central de apoio.", "Tem outra pergunta?"],
    "ru": ["Могу ли я помочь чем-то ещё?", "Попробуйте переформулировать вопрос.", "Обратитесь в службу поддержки.", "Есть ли у вас другие вопросы?"],
    "ja": ["ほかにご質問はありますか？", "質問を言い換えてみてください。", "サポート窓口にお問い合わせください。", "他にお手伝いできることはありますか？"],
    "zh": ["请问还有其他问题吗？", "您可以换一种问法。", "请联系客服。", "还需要其他帮助吗？"],
}
HEDGES = {
    "en": ["The document does not name an exact date, but this much is clear.", 'The page then shows "cannot answer, not found".', "It is not known who asked, but the rule is certain."],
    "de": ["Ein genaues Datum steht dort nicht, aber so viel ist klar.", "Danach erscheint die Meldung „nicht gefunden, abgelehnt“."],
    "fr": ["Le manuel ne donne pas de date, mais une chose est certaine.", "La page affiche alors « demande refusée, fichier introuvable »."],
    "es": ["El manual no indica la fecha, pero la regla es clara.", "La ventana muestra entonces «no encontrado, solicitud rechazada»."],
    "pt": ["O manual não indica a data, mas a regra é clara.", "A janela mostra então «não encontrado, pedido recusado»."],
    "ru": ["Точная дата в документе не указана, но правило ясно.", "Затем появляется сообщение «не найдено, отказано»."],
    "ja": ["資料に日付は書かれていませんが、規則は明確です。", "画面には「回答できません、見つかりません」と表示されます。"],
    "zh": ["资料没有写明具体日期，但规则很清楚。", "页面随后显示“无法回答，未找到”的提示。"],
}
PLACEHOLDERS = ["", " ", "\n\n", "　", "-", "--", "—", "–", "...", "…", "?", "??", "n/a", "N/A", "NA", "none", "None", "null", "NULL", "nil", "tbd", "TBD", "todo", "TODO", '""', "''", "[]", "{}", ".", "/", "_", "x", "xxx", "无", "暂无", "待补充", "待定", "空", "なし", "未定", "未記入", "нет", "пусто", "k. A.", "s/o", "vacío", "vazio", "[empty]", "(empty)", "<empty>", "undefined", "placeholder", "to be added", "to be done", "empty", "no answer"]
#: Words for each language as a question may ask for it.
ASKED = {
    "en": "english englisch anglais inglés inglês английском английски 英語 英语 英文", "de": "german deutsch allemand alemán alemão немецком немецки ドイツ語 德语 德文", "fr": "french französisch français francés francês французском французски フランス語 法语 法文",
    "es": "spanish spanisch espagnol español espanhol испанском испански スペイン語 西班牙语 西班牙文", "pt": "portuguese portugiesisch portugais portugués português португальском португальски ポルトガル語 葡萄牙语 葡萄牙文",
    "ru": "russian russisch russe ruso russo русском русски ロシア語 俄语 俄文", "ja": "japanese japanisch japonais japonés japonês японском японски 日本語 日语 日文", "zh": "chinese chinesisch chinois chino chinês китайском китайски 中国語 中文 汉语",
}

# Ordinary statements of each language, which neither decline nor close an answer.
ORDINARY = {
    "de": ["Der Fahrer bringt die Pakete jeden Morgen in das Lager.", "Die Leitung prüft den Vertrag und schickt ihn an die Filiale.", "Das Formular liegt im Ordner neben der Rechnung.", "Wir haben die Daten gestern in die neue Tabelle übertragen."],
    "en": ["The driver brings the parcels to the depot every morning.", "The manager checks the contract and sends it to the branch.", "The form is kept in the folder next to the invoice.", "We moved the records to the new table yesterday and shared a copy with the team."],
    "es": ["El conductor lleva los paquetes al almacén cada mañana.", "La dirección revisa el contrato y lo envía a la sucursal.", "El formulario está en la carpeta junto a la factura.", "Ayer pasamos los datos a la nueva tabla."],
    "fr": ["Le chauffeur apporte les colis au dépôt chaque matin.", "La direction vérifie le contrat et l'envoie à l'agence.", "Le formulaire se trouve dans le dossier à côté de la facture.", "Nous avons transféré les données dans le nouveau tableau hier."],
    "ja": ["運転手は毎朝荷物を倉庫に運びます。", "責任者は契約書を確認して支店に送ります。", "用紙は請求書の隣のフォルダーにあります。", "昨日、データを新しい表に移しました。"],
    "pt": ["O motorista leva as encomendas ao depósito todas as manhãs.", "A direção verifica o contrato e envia-o à filial.", "O formulário está na pasta ao lado da fatura.", "Ontem passámos os dados para a nova tabela."],
    "ru": ["Водитель каждое утро привозит посылки на склад.", "Руководство проверяет договор и отправляет его в филиал.", "Бланк лежит в папке рядом со счётом.", "Вчера мы перенесли данные в новую таблицу."],
    "zh": ["司机每天早上把包裹送到仓库。", "负责人检查合同并把它寄到分店。", "表格放在发票旁边的文件夹里。", "我们昨天把数据移到了新表里。"],
}
