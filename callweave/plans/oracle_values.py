"""Fixed values of the oracles, stated here once more so that an oracle doesn't share a table with what it checks."""

KEYWORDS = """
abstract actual and as assert async auto await bool break case catch char class companion const constexpr
continue crossinline data def default defer delete do double each else enum expect export extension external
final finally float for from fun func function goto guard if import in init inline instanceof int interface is
let long namespace new noexcept noinline not object of open operator or override private protected protocol
public register require return sealed short signed sizeof static struct super suspend switch tailrec template
then this throw throws try typedef typename typeof unsigned using var vararg void volatile when where while
with yield
""".split()
CATEGORIES = {'io': 'read|write|fetch|send|save|load|store|query|insert|update|delete|create|remove|get|set|post|put|patch',
 'handler': 'handle|on|render|process|execute|run|start|init|main|serve|listen',
 'util': 'format|parse|convert|transform|map|filter|reduce|sort|compare|validate|check|is|has|can|to|from'}
NAME_MODE = {'kotlin': ['kt', 'kts'],
 'java': ['java'],
 'swift': ['swift'],
 'typescript': ['ts', 'tsx', 'mts', 'cts'],
 'javascript': ['js', 'jsx', 'mjs', 'cjs'],
 'cfamily': ['c', 'h', 'cpp', 'hpp', 'cc', 'cxx', 'hh'],
 'python': ['py'],
 'go': ['go'],
 'objc': ['m', 'mm']}
QUALIFIED_MODE = {'typescript': ['ts', 'mts', 'cts', 'tsx'], 'javascript': ['js', 'mjs', 'cjs', 'jsx'], 'python': ['py'], 'java': ['java'], 'kotlin': ['kt', 'kts']}
VIEWER = {'typescript': ['ts', 'tsx'],
 'javascript': ['js', 'jsx', 'mjs', 'cjs'],
 'python': ['py'],
 'java': ['java'],
 'kotlin': ['kt', 'kts'],
 'json': ['json'],
 'css': ['css'],
 'scss': ['scss'],
 'less': ['less'],
 'html': ['html', 'htm'],
 'xml': ['xml', 'svg'],
 'markdown': ['md'],
 'yaml': ['yaml', 'yml'],
 'go': ['go'],
 'rust': ['rs'],
 'c': ['c', 'h'],
 'cpp': ['cpp', 'cc', 'hpp'],
 'csharp': ['cs'],
 'ruby': ['rb'],
 'php': ['php'],
 'shell': ['sh', 'bash'],
 'sql': ['sql']}
COLLECTED = ['ts', 'tsx', 'js', 'jsx', 'mjs', 'py', 'java', 'kt', 'kts', 'swift', 'css', 'html', 'json', 'md']
ACTIONS = {'get': 'get',
 'read': 'read',
 'load': 'load',
 'fetch': 'get',
 'find': 'find',
 'search': 'search',
 'query': 'query',
 'lookup': 'find',
 'list': 'list',
 'scan': 'scan',
 'analyze': 'analyse',
 'parse': 'parse',
 'decode': 'decode',
 'encode': 'encode',
 'format': 'format',
 'render': 'render',
 'draw': 'draw',
 'layout': 'lay out',
 'set': 'set',
 'update': 'update',
 'edit': 'edit',
 'apply': 'apply',
 'save': 'save',
 'store': 'store',
 'persist': 'persist',
 'write': 'write',
 'create': 'create',
 'build': 'build',
 'make': 'create',
 'generate': 'generate',
 'init': 'initialise',
 'setup': 'configure',
 'configure': 'configure',
 'delete': 'delete',
 'remove': 'remove',
 'clear': 'clear',
 'reset': 'reset',
 'validate': 'validate',
 'check': 'check',
 'verify': 'verify',
 'ensure': 'ensure',
 'is': 'decide',
 'has': 'decide',
 'can': 'decide',
 'send': 'send',
 'upload': 'upload',
 'publish': 'publish',
 'notify': 'notify',
 'receive': 'receive',
 'download': 'download',
 'sync': 'synchronise',
 'import': 'import',
 'export': 'export',
 'copy': 'copy',
 'open': 'open',
 'close': 'close',
 'show': 'show',
 'hide': 'hide',
 'select': 'select',
 'toggle': 'toggle',
 'schedule': 'schedule',
 'resolve': 'resolve',
 'rebuild': 'rebuild',
 'run': 'run',
 'execute': 'run',
 'process': 'handle',
 'handle': 'handle'}
EXTENSIONS = ["kt", "java", "swift", "ts", "tsx", "mts", "js", "cjs", "c", "hpp", "py", "go", "m", "mm", "css", "html", "json", "md", "KTS", "rs", "txt", ""]
