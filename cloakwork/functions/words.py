"""Word lists. All are fixed values: results must be the same as those of the rules they come from."""

from __future__ import annotations

#: Compound surnames, and common ones of a single rune.
COMPOUND_SURNAMES = (
    "欧阳 司徒 司马 上官 诸葛 尉迟 皇甫 夏侯 宇文 长孙 慕容 独孤 东方 南宫 公孙 令狐 闾丘 钟离 端木 拓跋 呼延 万俟 澹台 公冶 宗政 濮阳 淳于 单于 太叔 申屠 "
    "公羊 颛孙 轩辕 第五 梁丘 左丘 东郭 南门 百里 东门 西门 羊舌 微生 岳帅 缑亢 况后 有琴 亓官 仲孙 巫马 乐正 漆雕 壤驷 夹谷 宰父 谷梁 段干 赫连 皇象 褚师"
).split()
SINGLE_SURNAMES = list("王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许邓冯韩曹曾彭萧蔡潘田董袁于余叶蒋杜苏魏程吕丁沈任姚卢傅钟姜崔谭廖范汪陆金石戴贾韦夏邱方侯邹熊孟秦白江阎薛尹段雷黎史龙陶贺顾毛郝龚邵万钱严覃武戚莫孔向")
#: Runes that end a given name, and runes that may not stand before a surname.
GIVEN_STOPS, SURNAME_BLOCKS = "的了是在和与及或就都很不没有把被将从对向为以但而且因所如果虽然这那些个们呢吗吧啊呀哦嗯其乃即则却", "小老大阿"

#: Cues of the evidence chains, and what addresses are extended over.
CODE_SHORT = ("func ", "def ", "return ", "var ", "import ", "package ", "=>", "->", "::", "();", ");", "){")
CODE_ADDRESS = (*CODE_SHORT, "int ", "bool ")
CODE_NAME = ("func ", "def ", "return ", "var ", "let ", "const ", "class ", "import ", "package ", "public ", "static ", "=>", "->", "::", "&&", "||", "!=", "==", "();", ");", "){", "};", "int ", "bool ", "string ")
ADDRESS_VERBS = ("住在", "位于", "寄往", "地址", "收货", "送到", "邮寄", "所在")
DOOR_MARKS = ("号", "室", "层", "楼", "单元", "栋")
HONORIFICS = ("先生", "女士", "小姐", "老师", "医生", "经理", "主管", "总监", "同学", "同事", "Mr.", "Ms.", "Mrs.", "Dr.")
HUMAN_ACTS = ("说", "问", "答", "联系", "通知", "告诉", "签字", "签署", "负责", "提交", "提出", "提议", "审批", "出席", "参会", "表示", "认为", "指出", "强调", "建议", "主张", "回复", "打电话", "发邮件", "来电", "到访", "入职", "离职")
RELATIONS = ("的手机", "的邮箱", "的电话", "的身份证", "的地址", "客户", "员工", "用户", "经办人", "联系人", "收件人")
ORG_SUFFIXES = ("有限公司", "股份", "集团", "银行", "研究院", "事务所", "工作室", "中心", "协会", "基金会", "大学", "学院", "医院")
BUSINESS = ("供应商", "合同方", "甲方", "乙方", "客户", "合作", "采购", "签约", "开票", "抬头")
PLACE_SUFFIXES = ("省", "市", "区", "县", "镇", "乡", "村", "旗", "盟", "州", "路", "街", "道", "巷", "弄", "里", "胡同", "大街", "大道", "号", "号院", "栋", "幢", "座", "单元", "室", "层", "楼")
PLACE_STOPS = "的和与及或是在有等把被从对向为以"

#: What an organisation's name ends with, what is looked for before it, and where that ends.
ANCHORS_HAN = (
    "有限公司 股份有限公司 有限责任公司 集团 集团公司 公司 厂 分厂 工作室 事务所 研究院 研究所 设计院 医院 卫生院 诊所 学校 学院 大学 中学 小学 幼儿园 银行 支行 分行 信用社 "
    "法院 检察院 公安局 派出所 管理局 监督局 税务局 海关 委员会 办公室 中心 协会 商会 基金会 合作社 俱乐部 酒店 宾馆 超市 药房"
).split()
ANCHORS_LATIN = (
    "LTD LTD. INC INC. CORP CORP. GMBH Ltd Ltd. Limited LLC L.L.C. Inc Inc. Incorporated Corp Corp. Corporation Co Co. Company PLC plc LLP LP GmbH AG KG "
    "S.A. S.A.S. SARL S.r.l. SpA B.V. N.V. A/S AB AS Oy Pty Pte Foundation Institute University College Hospital Bank Group Holdings Partners Associates"
).split()
ADMINISTRATIVE = "省 市 区 县 镇 乡 村 旗 州 盟 中国 全国 国家 北京 上海 天津 重庆 广东 江苏 浙江 山东 河南 四川 湖北 湖南 河北 福建 安徽 陕西".split()
INDUSTRY = (
    "科技 技术 信息 网络 数据 智能 软件 电子 机械 制造 工业 建筑 工程 材料 化工 能源 医疗 生物 医药 健康 食品 农业 贸易 物流 金融 投资 资本 保险 证券 地产 置业 文化 "
    "传媒 教育 咨询 服务 管理 国际 实业 发展 工商 商业 人民 中级 基层 高级 第一 第二"
).split()
ORG_STOPS = "的和与及或是在有等把被将从对向为以了由于关至到去往找问经给跟让叫使请该其此那这"
#: Capitalised words that don't belong to a name.
LATIN_STOPS = (
    "the a an at by for from in of on to with and or but as into via per our your their his her its this that these those we i you they he she it see paid sent sold billed "
    "invoice contract note notes appendix section table figure chapter page exhibit schedule attn re cc subject january february march april may june july august september october "
    "november december jan feb mar apr jun jul aug sep sept oct nov dec monday tuesday wednesday thursday friday saturday sunday"
).split()

#: Marks of an entity that is somebody's own, and of one that a question is about.
OWN = ("住址", "家住", "住在", "居住", "户籍", "的地址", "的住所", "收货地址", "联系地址", "身份证", "客户", "患者", "员工", "lives at", "resides at", "home address", "his address", "her address", "customer", "patient", "employee")
TOPIC = ("怎么走", "怎么去", "邮编", "邮政编码", "在哪", "位于", "距离", "营业时间", "电话是多少", "介绍一下", "是什么公司", "属于哪", "how to get to", "directions to", "postcode", "zip code", "where is", "opening hours", "what company")

#: Attributes of telemetry that are never rewritten.
SKIP_KEYS = (
    "http.status_code http.response.status_code http.method http.request.method http.flavor http.scheme rpc.system rpc.grpc.status_code db.system messaging.system net.transport "
    "net.protocol.name net.protocol.version telemetry.sdk.name telemetry.sdk.language telemetry.sdk.version otel.status_code otel.library.name otel.library.version span.kind error.type"
).split()
