"""Results depend on exactly these words and numbers."""

from __future__ import annotations

# --- fixed values: documents, of 100,000, that hold a general word ---
TOTAL_DOCS = 100000
DOC_FREQ = {
    "こと": 90000, "もの": 85000, "ため": 80000, "とき": 75000, "ところ": 70000, "これ": 85000, "それ": 80000, "ある": 90000, "する": 95000, "なる": 88000, "いる": 87000, "ない": 85000, "できる": 75000,
    "会社": 50000, "時間": 55000, "場合": 60000, "方法": 45000, "問題": 48000, "必要": 52000, "可能": 40000, "情報": 45000, "結果": 42000, "関係": 38000, "利用": 35000, "対応": 33000, "確認": 30000, "実施": 28000, "管理": 32000, "設定": 25000, "作成": 27000, "処理": 20000, "機能": 22000,
    "システム": 15000, "データ": 18000, "サービス": 16000, "エンジン": 8000, "プログラム": 7000, "ソフトウェア": 6000, "ネットワーク": 7500, "コンピュータ": 9000, "インターネット": 8500, "ファイル": 5000, "フォルダ": 3000, "メール": 12000, "パソコン": 10000, "スマートフォン": 11000,
    "アプリケーション": 4000, "データベース": 3500, "アルゴリズム": 2000, "インターフェース": 2500, "プロトコル": 1500, "フレームワーク": 1800, "ライブラリ": 1200,
    "製造": 5000, "生産": 6000, "品質": 4500, "効率": 7000, "削減": 8000, "改善": 9000, "評価": 7500, "分析": 6500, "設計": 5500, "開発": 6000, "燃料": 3000, "エネルギー": 4000, "環境": 8000, "安全": 7000,
    "100": 30000, "10": 35000, "1": 40000, "2": 38000, "3": 36000, "2025": 500, "2024": 800, "80": 5000, "90": 4500, "％": 20000, "率": 15000,
    "クランクケース": 50, "ガス燃料噴射弁": 10, "アンモニアガス": 100, "混焼率": 30, "NOx": 200, "N2O": 80, "IMO": 150, "IHI": 100, "MAN": 120, "SCR": 80, "EGR": 70,
    "ターボチャージャー": 150, "インジェクタ": 100, "コモンレール": 60, "ピストンリング": 80, "カムシャフト": 90, "バルブタイミング": 70,
}
# --- fixed values: words that are no terms, nor start or end one ---
STOP_WORDS = (
    "こと", "もの", "とき", "ところ", "ため", "よう", "ほう", "わけ", "はず", "つもり", "とおり", "まま", "たち", "さん", "みたい", "そう", "ごと", "なか", "うえ", "した", "あと", "まえ", "つぎ", "ほか", "なに", "どこ", "だれ", "いつ", "どう", "どれ", "これ", "それ", "あれ", "ここ", "そこ", "あそこ", "こちら", "そちら", "あちら", "どちら", "など", "ら", "たり", "だけ", "ばかり", "ぐらい", "くらい", "ほど",
)
# --- fixed values: generic and layout words ---
GENERIC_WORDS = ("システム", "データ", "情報", "処理", "管理", "機能", "設定", "ファイル", "フォルダ", "エリア", "モード", "タイプ", "レベル", "状態", "結果", "対象", "内容", "項目", "要素", "部分", "全体")
LAYOUT_WORDS = ("図", "表", "ページ", "章", "節", "項", "参照", "以下", "上記", "次", "前", "後", "左", "右", "上", "下", "例", "まとめ")
# --- fixed values: common words, function words, suffixes, parts with a meaning of their own ---
COMMON_WORDS = ("こと", "もの", "ため", "など", "これ", "それ", "あれ", "どれ", "ここ", "そこ")
COMPOUND_COMMON = ("こと", "もの", "ため", "これ", "それ")
FUNCTION_WORDS = ("こと", "もの", "ため", "など")
JOINING_SUFFIXES = ("比", "率", "度", "値", "量", "数", "性", "力", "温", "圧", "速", "質", "型", "式", "法", "材", "器", "機", "体", "部", "品", "物", "液", "気")
TECHNICAL_SUFFIXES = ("率", "性", "度", "量", "値", "力", "機", "器", "弁", "式", "型", "法")
MEANINGFUL_PARTS = ("システム", "エンジン", "データ", "プロセス", "メソッド", "アルゴリズム", "プラットフォーム", "インターフェース", "アプリケーション", "サービス")
# --- fixed values: words of uncertainty, keywords of domains in order of priority ---
UNCERTAIN = ("不明", "わからない", "定義できない", "曖昧", "おそらく")
DOMAIN_KEYWORDS = {
    "engineering": ("エンジン", "機構", "設計", "システム", "制御"),
    "chemistry": ("化合物", "反応", "触媒", "分子", "濃度", "燃料", "燃焼"),
    "ai_ml": ("学習", "モデル", "データ", "アルゴリズム", "ネットワーク"),
}
# --- fixed values: templates of masked contexts; the mask stands for the term ---
MASK_TEMPLATES = {
    "definition": (("[MASK]とは", "[MASK]は", "[MASK]という用語は", "ここでいう[MASK]は", "専門用語の[MASK]は"), ("を意味する。", "である。", "を指す。", "と定義される。", "のことである。")),
    "explanation": (("この[MASK]について", "[MASK]を", "重要な[MASK]を", "[MASK]の概念を", "技術的な[MASK]を"), ("説明します。", "解説する。", "理解することが重要だ。", "検討する必要がある。", "分析してみよう。")),
    "calculation": (("[MASK]を", "[MASK]の値を", "正確な[MASK]を", "[MASK]について", "システムの[MASK]を"), ("計算する。", "算出する。", "求める。", "評価する。", "測定する。")),
    "application": (("[MASK]を使用して", "[MASK]による", "[MASK]を適用し", "[MASK]の技術で", "[MASK]方式により"), ("実装する。", "処理を行う。", "最適化する。", "改善する。", "実現する。")),
}
DOMAIN_TEMPLATES = {
    "engineering": (("設計", "構造", "性能", "効率", "機構"), ("{keyword}における[MASK]の重要性", "[MASK]による{keyword}の最適化", "{keyword}と[MASK]の関係")),
    "chemistry": (("反応", "濃度", "触媒", "化合物", "分子"), ("{keyword}中の[MASK]", "[MASK]を用いた{keyword}", "{keyword}における[MASK]の役割")),
    "ai_ml": (("学習", "モデル", "データ", "アルゴリズム", "精度"), ("{keyword}に基づく[MASK]", "[MASK]を使った{keyword}", "{keyword}における[MASK]の適用")),
}
# --- fixed values: contexts, openings and sentences that are made for a term ---
MADE_CONTEXT = "この{}は重要な専門用語です。"
MADE_OPENINGS = ("この{}は", "重要な{}")
MADE_SENTENCE = "{}について"
PERPLEXITY_TEMPLATES = ("この{}は専門用語である。", "{}について説明します。", "重要な概念である{}を理解する。")
NATURAL_SENTENCES = ("{}について説明します。", "この{}は重要です。", "{}の特徴を分析しました。")
# --- fixed values: runs of one script that count as context words ---
CONTEXT_RUNS = "[ぁ-ん]+|[ァ-ヴー]+|[一-龥]+|[A-Za-z0-9]+"
# --- end of fixed values ---
