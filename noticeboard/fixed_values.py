"""Fixed values.

Everything in this module is data that results depend on: word lists, weights,
sentinels, formats and patterns.  None of it is logic.  Operators take these as
parameters, so a caller can pass other lists.
"""

# --- fixed values: URL canonical form -------------------------------------
VOLATILE_QUERY_KEYS = [
    "t", "_t", "timestamp", "ts", "_", "rnd", "random", "r",
    "from", "source", "spm", "share", "shareid", "sharesource",
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "jsessionid", "sessionid", "sid", "phpsessid",
]
INDEX_FILENAMES = [
    "index.html", "index.htm", "index.shtml", "index.jsp", "index.php", "default.html",
]

# --- fixed values: categories, states, sentinels ---------------------------
CATEGORIES = ["housing", "subsidy", "rent_subsidy", "living_subsidy", "employment", "other"]
DEFAULT_CATEGORY = "other"
SCORED_CATEGORIES = ["housing", "subsidy", "rent_subsidy", "living_subsidy"]
WHOLE_CITY = "全市"
AUDIENCE_UNKNOWN = "详见官方正文"
DEADLINE_UNKNOWN = "以官方公告为准"
RECENTLY = "近期"
ALL_CITIES = "全部"
STATE_PENDING, STATE_SENT, STATE_BASELINE, STATE_ABANDONED = 0, 1, 2, 3
STATE_NAMES = {0: "pending", 1: "sent", 2: "baseline", 3: "abandoned"}

# --- fixed values: limits ---------------------------------------------------
SCORE_THRESHOLD = 2.5
MAX_AGE_DAYS = 45
MAX_NOTIFY_ATTEMPTS = 5
HEALTH_RUNS = 20
BROKEN_STREAK = 3
PUSH_LIMIT = 30
PENDING_VIEW_LIMIT = 100
DETAIL_LIMIT = 20
ALERT_COOLDOWN_HOURS = 24
KEEP_LOG_DAYS = 30
HEURISTIC_LINKS_MIN = 3
MIN_MAIN_TEXT_CHARS = 120
MIN_DETAIL_CHARS = 40
MAX_LINK_TEXT_SHARE = 0.35
WECOM_MAX_BYTES = 3800

# --- fixed values: blocklist, in order --------------------------------------
BLOCKLIST = [
    "商品房", "配售", "认购", "产权买卖", "购房资格", "销售公示", "二手房",
    "预售许可", "网签", "限购", "房产交易", "不动产登记",
    "中标", "废标", "招标", "采购", "比选", "询价", "施工许可", "规划许可",
    "监理", "造价", "竣工验收", "工程结算", "设备更新", "物业服务招标",
    "老旧小区", "加装电梯", "节能改造", "危房改造", "建筑机器人",
    "招聘", "拟聘用", "聘用人员公示", "笔试", "面试成绩", "资格复审",
    "考试成绩", "岗位表", "报考", "事业单位公开", "遴选", "选调",
    "体检结果", "拟录用", "录用公示", "退役大学生士兵",
    "行政处罚", "行政许可", "注销", "作废", "预算执行", "决算公开",
    "三公经费", "党建", "主题党日", "党课", "消防演习", "食堂", "车辆处置",
    "双随机", "抽查结果", "信用评价", "统计公报", "人事任免",
    "问卷调查", "征求意见反馈", "网站年报", "值班安排", "放假通知",
]

# --- fixed values: weighted terms, weak then medium then strong --------------
WEAK_TERMS = {
    "住房保障": 1.0, "租金": 0.8, "补助": 0.8, "扶持": 0.6, "资助": 0.8,
    "就业创业": 0.8, "实习见习": 0.8, "落户": 0.8, "安居": 1.0,
    "申请": 0.3, "公示": 0.3, "通告": 0.3, "政策": 0.3,
}
MEDIUM_TERMS = {
    "配租": 2.0, "认租": 2.0, "轮候": 2.0, "摇号": 1.8, "选房": 1.8,
    "分配方案": 1.5, "房源": 1.5, "申领": 1.5, "申报指南": 1.5,
    "人才引进": 1.8, "新引进人才": 2.0, "青年人才": 2.0,
    "高校毕业生": 1.5, "应届毕业生": 1.8, "应届生": 1.8, "大学生": 1.2,
    "毕业生": 1.2, "留学回国": 1.5, "补贴发放": 1.8, "补贴申报": 2.0,
}
STRONG_TERMS = {
    "人才公寓": 3.0, "青年公寓": 3.0, "青年驿站": 3.0, "青年人才驿站": 3.0,
    "保障性租赁住房": 3.0, "保租房": 3.0, "人才住房": 3.0, "人才安居": 3.0,
    "公租房": 2.5, "安居房": 2.5, "租赁补贴": 3.0, "租房补贴": 3.0,
    "住房补贴": 2.5, "生活补贴": 3.0, "安家补贴": 3.0, "落户补贴": 3.0,
    "购房补贴": 1.5, "见习补贴": 2.5, "求职创业补贴": 3.0, "就业补贴": 2.5,
    "青年发展型城市": 2.0, "人才补贴": 3.0, "青年人才补贴": 3.0,
}
ACTION_WORDS = ["配租", "认租", "申报", "申领", "发放", "受理", "开放", "启动", "公示", "分配"]
OBJECT_WORDS = ["公寓", "保租房", "补贴", "住房", "房源", "驿站", "安居"]
SOURCE_HINTS = ["住房保障", "人才安居", "住保", "人才服务"]
PAIR_BONUS, CATEGORY_BONUS, SOURCE_BONUS = 1.2, 0.5, 0.5
SHORT_TITLE_CHARS, SHORT_TITLE_FACTOR = 10, 0.5

# --- fixed values: category refinement, in order -----------------------------
CATEGORY_PATTERNS = [
    ("rent_subsidy", "租房补贴|租赁补贴|住房租赁补贴"),
    ("living_subsidy", "生活补贴|安家补贴|落户补贴|一次性.*补贴"),
    ("employment", "见习|实习|就业创业|求职"),
    ("housing", "公寓|保租房|保障性租赁住房|公租房|配租|认租|房源|安居"),
]

# --- fixed values: listing admission -----------------------------------------
HREF_SKIP_PREFIXES = ["javascript:", "mailto:", "tel:", "#", "data:"]
HREF_SKIP_EXTENSIONS = [
    ".jpg", ".jpeg", ".png", ".gif", ".bmp", ".css", ".js", ".ico", ".exe",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".7z",
]
RULE_NAV_TITLE = (
    "^(首页|上一页|下一页|末页|尾页|更多|返回|下载|打印|关闭|登录|注册|English|无障碍|长辈版|"
    "[0-9]+|>+|<+|[.]{2,}|全部|详情)$"
)
RULE_MIN_TITLE_CHARS = 6
HEURISTIC_NAV_TITLES = [
    "首页", "更多", "上一页", "下一页", "末页", "尾页", "返回顶部", "返回",
    "登录", "注册", "搜索", "网站地图", "联系我们", "关于我们", "版权声明",
    "无障碍", "长辈版", "English", "繁體", "打印", "关闭", "下载", "分享",
]
HEURISTIC_NAV_PARTS = ["上一页", "下一页", "更多>>", "返回顶部"]
HEURISTIC_MIN_TITLE_CHARS = 8
TITLE_ATTR_MIN_CHARS = 4
CHROME_TAGS = ["script", "style", "nav", "header", "footer", "aside", "form", "iframe"]
LIST_CONTAINER_TAGS = ["ul", "tbody", "table", "div", "ol"]

# --- fixed values: main-text selectors, in priority order ---------------------
CONTENT_SELECTORS = [
    "div.article-content", "div.articleCont", "div.art_content", "div.content_box",
    "div.TRS_Editor", "div.trs_editor", "div#zoom", "div#Zoom", "div.zoom",
    "div.article", "div.content", "div.detail-content", "div.detail_content",
    "div.view-content", "div.wznr", "div.xxgk_content", "div.news_content",
    "div.pages_content", "div.conTxt", "div.text", "article",
]

# --- fixed values: fetch outcomes ---------------------------------------------
STATUS_NOT_FOUND = [404, 410]
STATUS_REFUSED = [400, 401, 404, 405, 410, 451]
STATUS_BLOCKED_AFTER_RETRY = [403, 406, 412]
ERROR_HINTS = {
    "NOT_FOUND": "页面已不存在，请更新 url",
    "BLOCKED": "被网站反爬拦截，可尝试换网络环境或配置 crawler.proxy",
    "BAD_RULE": "规则配置有误",
}
ERROR_HINT_DEFAULT = "网络异常或站点故障"
EMPTY_HINT = "多半是官网改版导致选择器失效，请更新 rules.yaml 里的 selectors.list_item"

# --- fixed values: rule problems -----------------------------------------------
PROBLEM_NO_URL = "缺少 url 字段"
PROBLEM_URL_SCHEME = "url 必须以 http:// 或 https:// 开头，当前为: "
PROBLEM_NO_CITY = "缺少 city 字段"
PROBLEM_NO_SOURCE = "缺少 source_name 字段"
PROBLEM_PARSER = "parser_type 只支持 html、json 或 json_html，当前为: "
PARSER_TYPES = ["html", "json", "json_html"]

# --- fixed values: rule-trial hints ----------------------------------------------
HINT_NO_ROWS = "❌ 一条都没抓到：请检查 URL 是否正确、选择器是否匹配该页面结构。"
HINT_NO_MATCH = (
    "⚠️ 抓到 %d 条公告，但没有命中青年安居/补贴类政策。"
    "可能这个栏目本身就没有相关内容，换个专栏试试。"
)
HINT_OK = "✅ 抓到 %d 条公告，其中 %d 条是青年政策相关，规则有效！"

# --- fixed values: placeholder rows for an unlisted region -------------------------
PLACEHOLDER_TAG = "⚠️ 暂未收录"
PLACEHOLDERS = [
    ("housing", "暂未收录【%s】的住建局数据源", "%s住建局 (待录入)",
     "请手动填入【%s】住房和城乡建设局（或住房保障局）的通知公告页 URL。"),
    ("subsidy", "暂未收录【%s】的人社局数据源", "%s人社局 (待录入)",
     "请手动填入【%s】人力资源和社会保障局的通知公告页 URL。"),
    ("other", "暂未收录【%s】的政府门户数据源", "%s人民政府 (待录入)",
     "请手动填入【%s】市人民政府门户的通知公告页 URL。"),
]
REGION_SUFFIXES = ["省", "市", "区", "县"]
DEFAULT_LIST_ITEM = "ul li, div.news_list li, .list-item"

# --- fixed values: characters -------------------------------------------------------
# Whitespace as Unicode defines it, written so that it works inside a character
# class both in Java and in RE2.
WS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
TITLE_MARKS = "【】[]（）()《》<>“”\"'’‘·、,，。.:：!！?？-—_"
WIDE_DIGITS, ASCII_DIGITS = "０１２３４５６７８９", "0123456789"
CHINESE_DIGITS = {
    "零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5,
    "六": 6, "七": 7, "八": 8, "九": 9, "十": 10,
}

# --- fixed values: fact patterns -------------------------------------------------------
_S = f"[{WS}]*"
_D = "[0-9０-９]"
YMD = rf"({_D}{{4}}){_S}[-/.年]{_S}({_D}{{1,2}}){_S}[-/.月]{_S}({_D}{{1,2}}){_S}日?"
MD = rf"({_D}{{1,2}}){_S}[-/.月]{_S}({_D}{{1,2}}){_S}日?"
CLOCK = rf"{_S}(?:[0-2]?{_D}{_S}[:：]{_S}[0-5]{_D})?"
DEADLINE_EXPLICIT = [
    rf"(?:申报|申请|受理|提交|报名|登记|认租|选房)?{_S}(?:截止|结束){_S}(?:日期|时间|时限)?{_S}[为是：:至到]*{_S}{YMD}",
    rf"(?:截止|不得晚于|不迟于){_S}(?:到|至)?{_S}{YMD}",
    rf"{YMD}{_S}(?:前|之前|以前){_S}(?:提交|申报|申请|报送|完成)",
]
DEADLINE_RANGE = rf"{YMD}{CLOCK}{_S}(?:至|到|—|-|~|起至){_S}{YMD}{CLOCK}"
DEADLINE_MD_RANGE = rf"{MD}{_S}(?:至|到|—|-|~){_S}{MD}"
YEAR_IN_TEXT = rf"(20{_D}{{2}}){_S}年"
DEADLINE_RELATIVE = (
    rf"(?:之日起|发布之日起|起){_S}([0-9]{{1,3}}|[一二三四五六七八九十]+){_S}(?:个)?{_S}(工作日|日|天)内"
)
NUMBER = r"([0-9]+(?:\.[0-9]+)?)"
TIERED_AMOUNT = rf"(博士|硕士|研究生|本科|大专|专科|技师|高级工)[^，。；、\n]{{0,12}}?{NUMBER}{_S}(万元|万|元)"
MONTHLY_AMOUNT = rf"(?:每月|按月|月){_S}(?:补贴|发放|标准|租金)?{_S}(?:为|是|：|:)?{_S}{NUMBER}{_S}(元|万元)"
ONE_OFF_AMOUNT = rf"(?:一次性|共计|合计|总额)[^0-9\n]{{0,12}}?{NUMBER}{_S}(万元|万|元)"
GENERIC_AMOUNT = rf"(?:补贴|补助|资助|奖励){_S}(?:标准|金额|额度)?{_S}(?:为|是|：|:){_S}{NUMBER}{_S}(万元|万|元)"
QUOTA = rf"(?:共计|合计|共|房源|提供|推出|配租)[^0-9\n]{{0,12}}?([0-9]{{1,6}}){_S}(套|间|户)"
AUDIENCE_PATTERNS = [
    ("博士(?:研究生|后)?", "博士"),
    ("硕士(?:研究生)?|研究生", "硕士"),
    ("本科|学士", "本科"),
    ("大专|专科|高职", "专科"),
    ("应届(?:高校)?毕业生|应届生", "应届毕业生"),
    ("往届毕业生", "往届毕业生"),
    ("留学(?:回国)?(?:人员|生)|海外", "留学归国"),
    ("高层次人才|领军人才", "高层次人才"),
    ("新就业(?:大学生|职工|无房职工)", "新就业职工"),
    ("技能人才|技师|高级工", "技能人才"),
    ("创业(?:者|人员|团队)", "创业人员"),
]
GRADUATED_WITHIN = rf"毕业{_S}([0-9]|[一二三四五]){_S}年(?:以)?内"
AGE_BELOW = rf"年龄{_S}(?:在)?{_S}([0-9]{{2}}){_S}(?:周)?岁{_S}(?:及)?{_S}(?:以下|以内|below)"
AGE_NOT_OVER = rf"(?:不超过|未满|不满){_S}([0-9]{{2}}){_S}(?:周)?岁(?!{_S}的?{_S}(?:子女|儿童|未成年人))"
AGE_BETWEEN = rf"年龄{_S}([0-9]{{2}}){_S}[-—~至]{_S}([0-9]{{2}}){_S}(?:周)?岁"
CHANNEL_URL = rf"(https?://[^{WS}，。；、）)】\"'<>]{{8,120}})"
CHANNEL_ASSET = r"(?i)\.(jpg|jpeg|png|gif|css|js|ico|pdf)$"
CHANNEL_NAME = (
    rf"(?:登录|登陆|通过|进入|访问){_S}[“\"']?"
    rf"([^{WS}，。；、“”\"']{{4,30}}?(?:网|平台|系统|APP|app|小程序|公众号|窗口))[”\"']?"
)
SUMMARY_MIN_CHARS, SUMMARY_MAX_CHARS = 25, 130
SUMMARY_DOC_NUMBER = rf"^[〔\[（(]?{_D}{{4}}[〕\]）)]?{_S}第?{_S}{_D}+{_S}号"
SUMMARY_BOILERPLATE = "^(各|附件|来源|发布时间|字体|打印|分享|索引号)"
TITLE_AUDIENCE_PATTERNS = [
    ("博士", "博士"), ("硕士|研究生", "硕士"), ("本科", "本科"),
    ("大专|专科", "专科"), ("应届", "应届毕业生"),
]
TITLE_QUOTA = rf"([0-9]{{1,6}}){_S}(套|间|户)"
TITLE_BATCH = rf"(第[一二三四五六七八九十百0-9０-９]+批(?:次)?)"

# --- fixed values: date patterns ----------------------------------------------------------
PUBLISH_DATE = rf"({_D}{{4}})[-/.年]({_D}{{1,2}})[-/.月]({_D}{{1,2}})"
ROW_DATE_PATTERNS = [
    rf"({_D}{{4}}){_S}[-/.]{_S}({_D}{{1,2}}){_S}[-/.]{_S}({_D}{{1,2}})",
    rf"({_D}{{4}}){_S}年{_S}({_D}{{1,2}}){_S}月{_S}({_D}{{1,2}}){_S}日",
    rf"({_D}{{4}})({_D}{{2}})({_D}{{2}})(?!{_D})",
]
HEURISTIC_DATE = (
    rf"({_D}{{4}}){_S}[-/.年]{_S}({_D}{{1,2}}){_S}[-/.月]{_S}({_D}{{1,2}})"
    rf"|({_D}{{1,2}}){_S}[-/.月]{_S}({_D}{{1,2}}){_S}日?"
)
TITLE_DATE_PREFIX = rf"^[\[(【]{_S}{_D}{{4}}[-/.]{_D}{{1,2}}[-/.]{_D}{{1,2}}{_S}[\])】]{_S}"
TITLE_DATE_SUFFIX = rf"{_S}[\[(【]?{_S}{_D}{{4}}[-/.]{_D}{{1,2}}[-/.]{_D}{{1,2}}{_S}[\])】]?{_S}$"
TITLE_MORE_SUFFIX = rf"(更多|详情|查看){_S}[>》]+{_S}$"
META_CHARSET = r"(?i)<meta[^>]+charset\s*=\s*[\"']?\s*([a-zA-Z0-9_\-]+)"
