"""Lines that the built-in rules are about, in the catalogue's order: one that a rule finds, one of context that it asks for, one that mitigates it.

supply.workflow.env.secrets asks for a line feed within a line, so nothing that a diff holds can be found by it."""

SAMPLES = (
    ('auth', '', ''),
    ('localStorage.setItemtoken', '', ''),
    ('jwt.decode(', '', 'verify'),
    ('skipAuth', '', ''),
    ('password==', '', 'bcrypt'),
    ('md5(password', '', 'bcrypt'),
    ('log.resettoken', '', ''),
    ('updatepassword', 'user', 'currentPassword'),
    ('password:"AAAAAAAA"', '', 'os.Getenv'),
    ('apikey=x', '', ''),
    ('Authorization:Basic', 'http://', 'https://'),
    ('minLength=5', '', ''),
    ('user not found', '', ''),
    ('requireMFA:false', '', ''),
    ('mfa', 'verify', ''),
    ('rateLimit', 'login', ''),
    ('secure:false', '', ''),
    ('httpOnly:false', '', ''),
    ('sameSite:none', '', ''),
    ('invalidate', '', ''),
    ('regenerat', 'login', ''),
    ('sessionquery', 'set', 'generate'),
    ('maxAge', 'session', ''),
    ('consumeToken', 'reset', ''),
    ('domain:.a.a', '', 'domain:localhost'),
    ('rolechange', '', 'regenerateSession'),
    ('requireRole', '', ''),
    ('owner', '', ''),
    ('tenant', 'where', ''),
    ('skipAuthoriz', '', ''),
    ('params.id', 'find', 'owner'),
    ('canRead', '', ''),
    ('findUniqueid', 'request', 'tenant'),
    ('invoicefindMany', '', 'tenantId'),
    ('redirectquery', 'oauth', 'allowlist'),
    ('skipState', 'oauth', ''),
    ('skipNonce', 'oidc', ''),
    ('disablePKCE', 'oauth', ''),
    ('state', 'oauth', ''),
    ('webhookpost(', '', 'signature'),
    ('webhooksignature', '', 'timestamp'),
    ('webhookreq.json(', '', 'rawBody'),
    ('ParseWithClaims', 'jwt', 'issuer'),
    ('rotateRefresh', 'refresh', ''),
    ('jti', 'token', ''),
    ('Math.random(', 'token', ''),
    ('iv="AAAAAAAA"', '', ''),
    ('md5(', '', ''),
    ('DES', '', ''),
    ('xorEncrypt', '', ''),
    ('signature==signature', '', ''),
    ('log.privatekey', '', ''),
    ('alg:"none"', '', ''),
    ('skipVerify', '', ''),
    ('verify', '', ''),
    ('rsa.GenerateKey(x,512)', '', ''),
    ('pbkdf2=5', '', ''),
    ('RSA_PKCS1_PADDING', '', ''),
    ('crypto.createDecipher(', '', ''),
    ('jwtsecret="A"', '', ''),
    ('diffieHellman=512', '', ''),
    ('rows = select a from b where c = %s', '', ''),
    ('exec(', 'input', ''),
    ('fetch(', 'url', 'allowlist'),
    ('innerHTML', '', ''),
    ('pickle.loads', '', ''),
    ('ReadFile', '../', 'filepath.Clean'),
    ('multipart', 'save', 'mime'),
    ('InsecureSkipVerify:true', '', ''),
    ('credentials:true', 'origin:*', ''),
    ('log.token', '', ''),
    ('stacktrace', '', ''),
    ('new RegExp(', 'input', 'maxLength'),
    ('xml.Unmarshal', 'parse', 'resolve_entities=False'),
    ('redirect(', 'query', 'allowlist'),
    ('include(', 'filename', 'allowlist'),
    ('include(http://', '', ''),
    ('find({', 'req.body', 'sanitize'),
    ('ldap_search+', 'input', 'ldap_escape'),
    ('xpath+', 'input', 'parameterized'),
    ('setHeader+', '', 'replace'),
    ('Object.assignreq.', '', 'Object.create(null)'),
    ('hostredirect', '', 'allowlist'),
    ('http://x', '', 'upgrade-insecure-requests'),
    ('chat.completionscookie', '', ''),
    ('role:"system"req.', '', ''),
    ('tool_callsexecute', '', 'allowlist'),
    ('template.New', 'query', 'trustedTemplate'),
    ('eval(', '', ''),
    ('zip.OpenReader', 'join', 'filepath.Clean'),
    ('mime', 'upload', ''),
    ('ServeFile', 'filename', 'filepath.Clean'),
    ("import x from 'internal/admin/'", '', ''),
    ("import x from 'auth/'", '', ''),
    ("import x from 'privileged/'", '', ''),
    ('public-read', 'bucket', ''),
    ('public-read-write', 'bucket', ''),
    ('presign24*time.Hour', '', ''),
    ('Action:"*"', 'iam', ''),
    ('0.0.0.0/022', '', ''),
    ('publicly_accessible=true3306', '', ''),
    ('echosecret', '', ''),
    ('postinstall', '', ''),
    ('git+https://', '', ''),
    ('x', '', ''),
    ('integrity', '', ''),
    ('curl|sh', '', ''),
    ('uses:x@main', '', ''),
    ('permissions:write-all', '', ''),
    ('pull_request_target', '', ''),
    ('FROM x:latest', '', ''),
    ('ADD http://', '', ''),
    ('ARG PASSWORD', '', ''),
    ('ACTIONS_STEP_DEBUG', '', ''),
    ('env: DB_PASSWORD', '', ''),
    ('debug:true', '', ''),
    ('node_env:development', '', ''),
    ('cors*', '', ''),
    ('disableCSP', '', ''),
    ('tlsv1', '', ''),
    ('privileged:true', '', ''),
    ('hsts:false', '', ''),
    ('xframe:false', '', ''),
    ('xcontenttype:false', '', ''),
    ('Referrer-Policy:unsafe-url', '', ''),
    ('Permissions-Policy*', '', ''),
    ('script-src*', '', ''),
    ('frame-ancestors*', '', ''),
    ('<script src>', '', 'integrity='),
    ('USER root', '', ''),
    ('hostNetwork:true', '', ''),
    ('secretKeyRef', '', ''),
    ('containers:', '', 'securityContext'),
    ('sslmode=disable', '', ''),
    ('allowPublicKeyRetrieval=true', '', ''),
    ('redis.NewClient', '', 'Password'),
    ('log.request.body', '', ''),
    ('log.authorization', '', ''),
    ('log.email', '', ''),
    ('JSON.stringify(err)', '', ''),
    ('setAttributetoken', '', ''),
    ('log.diagnosis', '', ''),
    ('log.${', '', 'sanitize'),
    ('deleteUser', '', 'auditLog'),
    ('Object.assign(', 'req.body', 'pick'),
    ('price=req.', '', 'serverSide'),
    ('price=-', '', 'Math.abs'),
    ('paymentcreate', '', 'idempotency'),
    ('findAll', '', 'limit'),
    ('bodyParser', '', 'limit'),
    ('ws.Upgrade', '', 'CheckOrigin'),
    ('ws://', '', 'localhost'),
    ('OnMessage', '', 'validate'),
    ('ws.Upgrade', '', 'auth'),
    ('ws.Upgrade', '', 'rate'),
    ('ws.Upgrade', '', 'ping'),
    ('os.Stat', 'write', 'O_EXCL'),
    ('os.Open', '/tmp/', 'O_NOFOLLOW'),
    ('selectupdate', 'balance', 'FOR UPDATE'),
    ('++', 'findsave', 'for '),
    ('introspection:true', '', ''),
    ('graphql', '', 'maxDepth'),
    ('graphql', '', 'complexityLimit'),
    ('import "unsafe"', '', ''),
    ('import _ "net/http/pprof"', '', 'BasicAuth'),
    ('&http.Server{', '', 'ReadTimeout'),
    ('json.Unmarshal(interface{}', 'req.Body', ''),
    ('postMessage(', '', 'origin'),
    ('target="_blank"', '', 'rel="noopener'),
    ('document.domain=', '', ''),
    ('//# sourceMappingURL=', '', ''),
    ('.git/', '', ''),
    ('.bak', '', ''),
    ('grpc.NewServer(', '', 'credentials.NewTLS'),
    ('reflection.Register(', '', ''),
)
